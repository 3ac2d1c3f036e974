"""Registered queries: JSON sources and sinks, fed with the documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.operators import corpus
from stepwright.plans import inputs
from stepwright.plans import oracle_inputs as sql
from stepwright.plans.corpus import CUT_SQL, LABEL_SQL, SCORED_LABEL, file_positions, label_text
from stepwright.plans.corpus import ORACLES as CORPUS_ORACLES
from stepwright.sources import json_files, schemas, versions
from stepwright.sources.tables import table
from stepwright.sources.workspace import new_path

DOCUMENT = "doc_id bigint, lang string, source string, text string"
PARTS = "part-*"   # what Spark names the files it writes


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "text")


def _array_folder(spark: SparkSession, sf: str) -> str:
    """The documents as a folder of JSON array files."""
    path = new_path(spark, "arrays")
    json_files.write_json_arrays(_documents(spark, sf), path)
    return path


def scan_json_array_dir(spark: SparkSession, sf: str) -> DataFrame:
    scan = json_files.read_json_arrays(spark, _array_folder(spark, sf), DOCUMENT, PARTS)
    return json_files.good_records(scan).drop("source_file", "idx")


def _damaged_lines(docs: DataFrame) -> DataFrame:
    """Per document a JSON line, a blank line, and for one source a line cut short."""
    line = F.to_json(F.struct("doc_id", "lang", "source", "text"))
    cut = F.when(F.col("source") == "src5", F.substring(line, F.lit(1), F.length(line) - 2))
    lines = F.filter(F.array(line, F.lit(" \t"), cut), lambda x: x.isNotNull())
    return docs.select(F.explode(lines).alias("value"))


def scan_jsonl_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    """Good lines with their text, and the malformed ones by the id that can be made out."""
    path = new_path(spark, "lines")
    _damaged_lines(_documents(spark, sf)).write.text(path)
    rows = json_files.read_json_lines(spark, path, DOCUMENT)
    good = json_files.good_records(rows).select(F.lit("good").alias("kind"), "doc_id", "text")
    bad = json_files.quarantined(rows).select(
        F.lit("bad").alias("kind"), F.regexp_extract("raw", r'^\{"doc_id":(\d+),', 1).cast("bigint").alias("doc_id"),
        F.lit(None).cast("string").alias("text"))
    return good.unionByName(bad)


def quarantine_corrupt(spark: SparkSession, sf: str) -> DataFrame:
    """Array files, those of one source never closed: rows of the others, quarantine of these."""
    path, docs = new_path(spark, "files"), _documents(spark, sf)
    damaged = F.col("source") == "src5"
    json_files.write_json_arrays(docs.where(~damaged), f"{path}/folder=sound")
    element = F.concat(F.lit("["), F.to_json(F.struct("doc_id", "lang", "source", "text")))
    docs.where(damaged).select(element.alias("value")).write.text(f"{path}/folder=damaged")
    scan = json_files.read_json_arrays(spark, path, DOCUMENT, PARTS)
    good = F.col(json_files.CORRUPT).isNull()
    return scan.groupBy("folder", "source").agg(
        F.count_if(good).alias("good"), F.max((~good).cast("int")).alias("quarantined"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


def record_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    """Records numbered per file, before any is dropped.

    Files are written in key order, so each file's numbers follow its keys.
    """
    path = new_path(spark, "ordered")
    ordered = _documents(spark, sf).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    json_files.write_json_arrays(ordered, path)
    rows = json_files.good_records(json_files.read_json_arrays(spark, path, DOCUMENT, PARTS))
    first = rows.groupBy("source_file").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "source_file").select(
        "doc_id", (F.col("idx") - 1 + F.col("first_id")).alias("id_by_position"), "text")


def scan_split_files(spark: SparkSession, sf: str) -> DataFrame:
    """Train and eval files read as one table with their name."""
    files = {name: new_path(spark, name) for name in ("train", "eval")}
    marked = corpus.seeded_split(file_positions(spark, sf), "source_file", "position")
    docs = _documents(spark, sf).join(marked.select("doc_id", "split"), "doc_id")
    for name, path in files.items():
        wanted = "train" if name == "train" else "test"
        json_files.write_json_lines(docs.where(F.col("split") == wanted).drop("split"), path)
    return json_files.read_splits(spark, files, DOCUMENT)


def sink_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned process records written as JSON Lines and read back."""
    path = new_path(spark, "cleaned")
    json_files.write_json_lines(corpus.clean_process(inputs.processes(spark, sf)), path)
    return _cleaned(spark, path)


def sink_published(spark: SparkSession, sf: str) -> DataFrame:
    """Process records published as they are, then, read from there, cleaned and published again."""
    path = new_path(spark, "published")
    versions.publish_json_lines(inputs.processes(spark, sf), path)
    raw = json_files.good_records(
        json_files.read_json_lines(spark, versions.published(spark, path), schemas.PROCESS)).drop("source_file")
    versions.publish_json_lines(corpus.clean_process(raw), path)
    return _cleaned(spark, versions.published(spark, path))


def _cleaned(spark: SparkSession, path: str) -> DataFrame:
    back = json_files.good_records(json_files.read_json_lines(spark, path, schemas.PROCESS))
    return back.select("idx", "question", "preference", "process", label_text(F.col("label")).alias("label"),
                       F.round(F.col("final_score").cast("double"), 6).alias("final_score"))


def sink_by_source_file(spark: SparkSession, sf: str) -> DataFrame:
    """Train and test folders per source file, found again by their folder names."""
    path = new_path(spark, "by_file")
    marked = corpus.seeded_split(file_positions(spark, sf), "source_file", "position")
    docs = _documents(spark, sf).select("doc_id", "text").join(marked, "doc_id")
    json_files.write_by_file(docs, path, "split", "source_file")
    return spark.read.schema(
        "doc_id bigint, text string, position bigint, split string, source_file string").json(path)


def _triples(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.explode_responses(inputs.multi_responses(spark, sf)).select("instruction", "input", "output")


def sink_single_collection(spark: SparkSession, sf: str) -> DataFrame:
    """All training triples in one collection, repeats kept."""
    path = new_path(spark, "triples")
    json_files.write_json_lines(_triples(spark, sf), path)
    return spark.read.schema("instruction string, input string, output string").json(path)


def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of documents, pages and turns as one bag."""
    def named(name: str, key: Column, text: str) -> DataFrame:
        return table(spark, sf, name).select(F.lit(name).alias("origin"), key.alias("key"), F.col(text).alias("text"))

    return (named("documents", F.col("doc_id"), "text")
            .unionByName(named("pages", F.col("page_id"), "html"))
            .unionByName(named("conversations", F.col("conv_id"), "text")))


QUERIES = {f.__name__: f for f in (
    scan_json_array_dir, scan_jsonl_tolerant, quarantine_corrupt, record_ordinal, scan_split_files,
    sink_jsonl, sink_published, sink_by_source_file, sink_single_collection, union_sources)}

SPLIT = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS position,
    count(*) OVER (PARTITION BY lang) AS n FROM documents),
split AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(position || '|42'), position)
  <= floor(n * 0.9::DOUBLE) AS train FROM numbered)"""

ORACLES = {
    "scan_json_array_dir": "SELECT doc_id, lang, source, text FROM documents",
    "scan_jsonl_tolerant": """SELECT 'good' AS kind, doc_id, text FROM documents UNION ALL
        SELECT 'bad', doc_id, NULL FROM documents WHERE source = 'src5'""",
    "quarantine_corrupt": """SELECT CASE WHEN source = 'src5' THEN 'damaged' ELSE 'sound' END AS folder,
          CASE WHEN source <> 'src5' THEN source END AS source, count(*) FILTER (source <> 'src5') AS good,
          max(CASE WHEN source = 'src5' THEN 1 ELSE 0 END) AS quarantined,
          sum(CASE WHEN source <> 'src5' THEN length(text) ELSE 0 END)::BIGINT AS chars
        FROM documents GROUP BY ALL""",
    "record_ordinal": "SELECT doc_id, doc_id AS id_by_position, text FROM documents",
    "scan_split_files": f"""WITH {SPLIT}
        SELECT doc_id, lang, source, text, CASE WHEN train THEN 'train' ELSE 'eval' END AS split FROM split""",
    "sink_by_source_file": f"""WITH {SPLIT}
        SELECT doc_id, text, position, CASE WHEN train THEN 'train' ELSE 'test' END AS split, lang AS source_file
        FROM split""",
    "sink_jsonl": f"""WITH {sql.PROCESS}
        SELECT idx, question, preference, {CUT_SQL} AS process, {LABEL_SQL.format(SCORED_LABEL)} AS label,
          round(final_score, 6) AS final_score FROM process""",
    "sink_single_collection": f"""SELECT instruction, input, output FROM ({CORPUS_ORACLES['explode_responses']})""",
    "union_sources": """SELECT 'documents' AS origin, doc_id AS key, text FROM documents UNION ALL
        SELECT 'pages', page_id, html FROM pages UNION ALL SELECT 'conversations', conv_id, text FROM conversations""",
}
ORACLES["sink_published"] = ORACLES["sink_jsonl"]
