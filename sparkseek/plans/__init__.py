"""From query text to a validated plan: lexer, parser, normalizer, translators."""
