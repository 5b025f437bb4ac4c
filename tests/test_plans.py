"""What the plans of the registered queries must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from veilwork.functions.scale import lookup_join, running_before
from veilwork.operators import batch, dedup
from veilwork.options import RedactOptions
from veilwork.plans.catalog import CATALOG
from veilwork.sources.tables import read_table

FOLDER = "/root/testdata/sf0.001"
BATCH = [n for n in CATALOG if not n.startswith("stream")]
# Queries that only project, filter or explode rows where they lie.
NARROW = (
    "remove_pii_pages", "ner_mode", "image_format", "image_text_likelihood", "ocr_mode_reason", "image_info",
    "thumbnail_eligible", "drop_logo_images", "fit_image_width", "output_name", "report_rows", "oversized_files",
    "processing_summary", "ops_label",
)


def plan(spark, name):
    return registry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_python_only_for_office_files(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert ("MapIn" in text) == name.startswith(("docx_", "batch_results", "batch_status", "anonymize_from_table"))
    assert "SinglePartition" not in text


@pytest.mark.parametrize("name", NARROW)
def test_narrow_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", ["limit_files", "dedupe_page_images", "results_by_order"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_scans_read_only_what_is_used(spark):
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string,source:string>", plan(spark, "pii_summary"))
    assert re.search(r"ReadSchema: struct<event_id:bigint>", plan(spark, "ops_label"))
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,60)" in plan(spark, "redact_spans")


def test_process_once_sends_no_text_of_single_contents(spark):
    """The branch of contents without copies has no exchange but the lookup; before it only fingerprints move."""
    docs = read_table(spark, FOLDER, "documents").select("doc_id", "text")
    node = dedup.process_once(docs, lambda u: u, RedactOptions(remove_pii=True))._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Union":
        node = node.children().head()
    alone = node.children().head().toString()
    assert "Aggregate" not in alone and "Repartition" not in alone
    assert alone.count("Join") == alone.count("strategy=broadcast") == 1


def test_process_once_beyond_the_broadcast_limit(spark):
    docs = spark.createDataFrame([(i, f"t{i % 7 if i % 3 else 0}") for i in range(90)], "doc_id long, text string")
    opts, double = RedactOptions(remove_pii=True), lambda u: u.withColumn("text", F.concat("text", "text"))
    small, large = (dedup.process_once(docs, double, opts, limit=n) for n in (1 << 20, 0))
    assert "strategy=broadcast" in small._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in large._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(small.collect()) == sorted(large.collect())
    assert sum(not r.cache_hit for r in small.collect()) == 7


def scans(spark, name):
    """Scans and equal exchanges that ran once, in the plan that was run."""
    df = registry.queries()[name](spark, FOLDER)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return final.count("FileScan"), final.count("ReusedExchange")


@pytest.mark.parametrize("name", ["file_listing", "number_tables", "ocr_gate", "report_images"])
def test_numbers_are_given_in_one_scan(spark, name):
    assert scans(spark, name) == (1, 1)


def test_running_sums_of_a_hot_key_with_sparse_positions(spark):
    """A third of the rows under one key, positions far apart, null keys, and a value that is not there."""
    rows = [("hot" if i % 3 == 0 else f"k{i % 5}" if i % 7 else None, (i * 7919) % 4001 * 1000, None if i % 11 == 0 else i, "x" * (i % 4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at long, n long, wide string").repartition(5)
    got = running_before(df, ["k"], ["at"], F.col("n"), "before", bucket=1 << 16)
    seen, expected = {}, []
    for k, at, n, wide in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        expected.append((k, at, n, wide, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + (n or 0)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_contents_stay_where_they_lie_when_few_files_are_refused(spark):
    rows = [(f"b{i % 6}", i, b"x" * (i % 50)) for i in range(120)]
    df = spark.createDataFrame(rows, "batch_id string, ord long, content binary").withColumn("size", F.octet_length("content").cast("long"))
    given = dict(max_files=15, max_file=48)
    small, large = batch.admit_documents(df, **given), batch.admit_documents(df, **given, limit=0)
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("strategy=broadcast") == 1 and "Aggregate" not in plan and "Repartition" not in plan
    assert "strategy=broadcast" not in large._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, small.collect()))
    assert got == sorted(map(tuple, large.collect()))
    reasons = {r[1]: r[-1] for r in got}
    assert sum(r is None for r in reasons.values()) == 5 * 15 and reasons[119] == "More than 15 files in the batch"
    assert reasons[49] == "File is larger than the limit" and reasons[1] == "Another file of the batch is larger than the limit"


def test_lookups_beyond_the_limit_are_not_broadcast_after_all(spark):
    """Refused places are not repeated, and Spark does not broadcast a lookup whose file looks small."""
    rows = [(f"b{i % 6}", i, i % 50) for i in range(120)] + [(None, 1, 1), ("b1", None, 1), ("b1", 7, 3)]
    df = spark.createDataFrame(rows, "batch_id string, ord long, size long")
    judged = batch.admit_documents(df, max_files=15, limit=0)
    text = judged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text and "Generate" not in text
    assert sorted(map(str, judged.collect())) == sorted(map(str, batch.admit_documents(df, max_files=15).collect()))
    salted = lookup_join(df, spark.createDataFrame([("b1", 2)], "batch_id string, n long"), ["batch_id"], "ord", F.lit(8), limit=0)
    text = salted._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    assert salted.where("n = 2").count() == 22


@pytest.mark.parametrize("name, scans", [("page_records", 5), ("page_documents", 3)])
def test_page_requests_read_each_input_once(spark, name, scans):
    """One union, one exchange by document; tables and images are not read where no record is asked for."""
    text = plan(spark, name)
    assert text.count("FileScan") == scans and "Join" not in text and "Window" not in text
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L, _alone", text)) == 1
    dealt = len(re.findall(r"Exchange hashpartitioning\(\w+#\d+L, \d+\), REPARTITION_BY_NUM", text))
    assert text.count("Exchange hashpartitioning") == 1 + dealt
