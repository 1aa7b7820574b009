"""The search domains built from the test tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshot import Snapshot

#: Milliseconds of a timestamp without zone that is meant as UTC, whatever the session's zone is.
_MS = "unix_millis(cast(convert_timezone('UTC', current_timezone(), ts) as timestamp))"
#: Text of each derived table: (Spark SQL over the base view, DuckDB SQL).
_BOTH: dict[str, tuple[str, str, str]] = {
    "repos": (
        "nation",
        """SELECT concat('src', n_nationkey) repo, 1700000000000L + n_nationkey * 86400000L latest_commit_ms,
           map('nation', lower(n_name), 'region', concat('r', n_regionkey)) meta, array(concat('topic', n_nationkey % 4)) topics,
           concat('Nation ', n_name, ' of region ', n_regionkey) description, n_nationkey % 5 = 0 fork, n_nationkey % 7 = 0 archived,
           if(n_nationkey % 2 = 0, 'public', 'private') visibility, array(concat('ctx', n_nationkey % 3)) contexts FROM {t}""",
        "SELECT 'src' || n_nationkey AS repo, n_nationkey AS k, n_name, n_regionkey FROM nation",
    ),
    "owners": (
        "documents",
        """SELECT source repo, concat(source, '/', lang, '/', doc_id, '.txt') path,
           if(doc_id % 3 = 0, cast(array() as array<string>), array(concat('team', doc_id % 7))) owners FROM {t}""",
        "",
    ),
    "contributors": (
        "documents",
        """SELECT source repo, concat(source, '/', lang, '/', doc_id, '.txt') path, array(named_struct('canonical', concat('u', doc_id % 11),
           'name', concat('User ', doc_id % 11), 'email', concat('u', doc_id % 11, '@example.org'))) contributors FROM {t}""",
        "",
    ),
    "symbols": (
        "part",
        """SELECT p_partkey symbol_id, concat('src', p_partkey % 20) repo, concat('lib/', p_brand, '.rs') path, 'rust' lang, lower(p_type) kind,
           concat(element_at(split(p_name, ' '), 1), initcap(element_at(split(p_name, ' '), 2))) local_name,
           concat(replace(lower(p_type), ' ', '_'), '::', replace(p_name, ' ', '_')) qualified_name,
           cast(p_partkey % 100 as int) start_line, cast(p_partkey % 100 + p_size as int) end_line FROM {t}""",
        """SELECT p_partkey AS symbol_id, 'src' || p_partkey % 20 AS repo, 'lib/' || p_brand || '.rs' AS path, 'rust' AS lang, lower(p_type) AS kind,
           split_part(p_name, ' ', 1) || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS local_name,
           replace(lower(p_type), ' ', '_') || '::' || replace(p_name, ' ', '_') AS qualified_name,
           (p_partkey % 100)::INTEGER AS start_line, (p_partkey % 100 + p_size)::INTEGER AS end_line FROM part""",
    ),
    "commits": (
        "events",
        """SELECT cast(event_id as string) sha, if(event_id > 0, array(cast(event_id - if(event_id % 10 = 9, 2, 1) as string)), cast(array() as array<string>)) parents,
           concat('user', user_id) author, concat('user', user_id % 50) committer, concat(event_type, ' of item ', get_json_object(props, '$.k')) message,
           {ms} committer_time_ms, {ms} author_time_ms, false is_merge FROM {t}""",
        """SELECT event_id::VARCHAR AS sha, event_id AS n, event_id - CASE WHEN event_id % 10 = 9 THEN 2 ELSE 1 END AS parent, 'user' || user_id AS author,
           'user' || user_id % 50 AS committer, event_type || ' of item ' || json_extract_string(props, '$.k') AS message, epoch_us(ts) // 1000 AS committer_time_ms FROM events""",
    ),
    "hunks": (
        "lineitem",
        """SELECT cast(l_orderkey as string) sha, concat('part/', l_partkey, '-', l_linenumber) path, concat('@@ ', l_linenumber) header,
           concat('returned ', l_returnflag) added, if(l_linestatus = 'O', 'open line', '') removed, '' touched FROM {t}""",
        """SELECT l_orderkey::VARCHAR AS sha, 'part/' || l_partkey || '-' || l_linenumber AS path, '@@ ' || l_linenumber AS header,
           'returned ' || l_returnflag AS added, CASE WHEN l_linestatus = 'O' THEN 'open line' ELSE '' END AS removed, '' AS touched FROM lineitem""",
    ),
    "refs": ("events", "SELECT 'main' name, cast(max(event_id) as string) sha FROM {t}", "SELECT 'main' AS name, max(event_id)::VARCHAR AS sha FROM events"),
    "tags": (
        "events",
        "SELECT concat('v', event_id div 100) name, cast(event_id as string) sha FROM {t} WHERE event_id % 100 = 0",
        "SELECT 'v' || event_id // 100 AS name, event_id::VARCHAR AS sha FROM events WHERE event_id % 100 = 0",
    ),
    "dirty": ("labels", "SELECT doc_id candidate_id, doc_id * 1000 applied_at_ms FROM {t} WHERE toxic = 1", "SELECT DISTINCT doc_id AS candidate_id FROM labels WHERE toxic = 1"),
    "changed": (
        "documents",
        "SELECT concat(source, '/', lang, '/', doc_id, '.txt') path, 1700000000000L + doc_id * 1000 applied_at_ms FROM {t}",
        "",
    ),
    "facets": (
        "documents",
        "SELECT doc_id candidate_id, concat('team', doc_id % 7) owner, concat('svc', doc_id % 5) service, lang layer, source surface FROM {t}",
        "",
    ),
    "snapshots": ("labels", "SELECT concat('quality', quality) name, doc_id candidate_id FROM {t}", "SELECT 'quality' || quality AS name, doc_id AS candidate_id FROM labels"),
    "affected": ("benchmark", "SELECT concat('item', item_id % 4) key, item_id * 3 candidate_id FROM {t}", ""),
    "invalidated": ("benchmark", "SELECT concat('item', item_id % 4) key, item_id * 5 candidate_id FROM {t}", ""),
    "head": ("region", "SELECT 2000L head_ms, 1000L materialized_ms FROM {t} WHERE r_regionkey = 0", ""),
    "nodes": (
        "conversations",
        """SELECT conv_id tree_id, conv_id candidate_id, -1L node_id, -2L parent_id, 0L ord, 'conversation' kind, 0L start, 1000000L end, '' text FROM {t} WHERE turn = 0
           UNION ALL SELECT conv_id, conv_id, turn, -1L, turn, role, turn, turn + 1, element_at(split(lower(text), '[ \\n]'), 1) FROM {t}""",
        "",
    ),
    "entries": (
        "part",
        """SELECT concat('part', p_partkey) identity, p_brand owner_path, cast(p_retailprice * 10 as long) score_millis, cast(p_size as long) tokens, lower(p_name) search_text FROM {t}""",
        "",
    ),
    "graph_edges": (
        "lineitem",
        "SELECT DISTINCT l_returnflag kind, concat('s', l_suppkey) source, concat('p', l_partkey) target FROM {t}",
        "SELECT DISTINCT l_returnflag AS kind, 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem",
    ),
    "clusters": ("embeddings", "SELECT label card, vec_id member FROM {t}", ""),
}


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("candidate_id"), F.col("source").alias("repo"), F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        "lang", F.lit(1).alias("start_line"), F.size(F.split("text", "\n", -1)).alias("end_line"), "text",
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of documents of the same number; the label is the corpus."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("vector"), F.concat(F.lit("c"), "label").alias("corpus"))
    return v.join(chunks(spark, sf_dir).drop("text", "end_line").withColumn("end_line", F.lit(1)), "candidate_id")


def snapshot(spark: SparkSession, sf_dir: str, *names: str) -> Snapshot:
    """Chunks and the further tables that a query names; nothing is read before the query runs."""
    made = {}
    for name in names:
        if name == "embeddings":
            made[name] = embeddings(spark, sf_dir)
        elif name != "chunks":
            base, text, _ = _BOTH[name]
            made[name] = spark.sql(text.format(t="{t}", ms=_MS), t=spark.read.parquet(f"{sf_dir}/{base}.parquet"))
    return Snapshot(chunks=chunks(spark, sf_dir), **made)


def duck(name: str) -> str:
    return _BOTH[name][2]


TOKENS = r"'[\p{L}\p{N}\p{M}_]+'"
CHUNKS = rf"""d AS (
  SELECT doc_id AS candidate_id, source AS repo, source || '/' || lang || '/' || doc_id || '.txt' AS path, lang, 1::INTEGER AS start_line,
         len(string_split(text, chr(10)))::INTEGER AS end_line, text, lower(text) AS f, regexp_extract_all(lower(text), {TOKENS}) AS t,
         regexp_extract_all(lower(source || '/' || lang || '/' || doc_id || '.txt'), {TOKENS}) AS pt
  FROM documents
)"""
VECTORS = """e AS (
  SELECT vec_id AS candidate_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, 'c' || label AS corpus, d.repo, d.path, d.lang
  FROM embeddings JOIN d ON d.candidate_id = vec_id
)"""
