"""Extraction, resolution, reading and streaming of tables."""

import json

import pytest

from citeloom import api
from citeloom.operators.extract import citation_counts, clusters, extract, resolve
from citeloom.schema import Options
from citeloom.sources import readers, registry
from citeloom.streaming.extract import stream_documents, stream_extract

DOCS = [(1, "R v Jordan, 2016 SCC 27 [Jordan]. Ibid at para 5. Jordan, supra note 1."), (2, "See [2016] 1 SCR 631."), (3, None), (4, ""), (5, "no citation"), (6, "2016 CSC 27")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_extract_is_the_same_over_any_partitions(docs):
    a = extract(docs.repartition(1)).orderBy("doc_id", "index").collect()
    assert a == extract(docs.repartition(5)).orderBy("doc_id", "index").collect()
    assert [(r["doc_id"], r["form"], r["antecedent"]) for r in a] == [(1, "full", None), (1, "ibid", 0), (1, "supra", 0), (2, "full", None), (6, "full", None)]
    assert a[0]["url"].endswith("2016scc27.html") and a[0]["key"] == a[4]["key"]


def test_resolve_clusters_and_counts(spark, docs):
    found = extract(docs, options=Options(resolve=False))
    assert {tuple(r) for r in resolve(found).collect()} == {(1, 1, 0, "ibid_previous"), (1, 2, 0, "name_only")}
    found = extract(docs)
    assert {(r["doc_id"], tuple(r["members"]), r["name"]) for r in clusters(found).collect()} == {(1, (0, 1, 2), "R v Jordan"), (2, (0,), "[2016] 1 SCR 631"), (6, (0,), "2016 CSC 27")}
    counts = {r["key"]: (r["citations"], r["documents"]) for r in citation_counts(found).collect()}
    assert counts["4:neutral:2016:scc:27"] == (4, 2)


def test_counts_read_each_text_once_and_only_their_columns(spark, docs):
    every = extract(docs)
    few = extract(docs, columns=("index", "antecedent", "key"))
    assert few.columns == ["doc_id", "index", "antecedent", "key", "error"]
    assert sorted(few.collect()) == sorted(every.select(*few.columns).collect())
    counts = citation_counts(few)
    assert counts._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(counts.collect()) == sorted(citation_counts(every).collect())
    with pytest.raises(ValueError, match="unknown columns"):
        extract(docs, columns=("nothing",))


def test_counts_of_odd_citations(spark):
    """Ids that are null or occur twice, antecedents without a key or that are not there."""
    rows = [(1, 0, None, "a"), (1, 1, 0, None), (1, 2, 0, "b"), (1, 3, 9, None), (2, 0, None, None), (2, 1, 0, None), (3, 0, None, "a"), (3, 0, None, "c"), (3, 1, 0, None), (None, 0, None, "a"), (None, 1, 0, None), (4, None, None, None)]
    c = spark.createDataFrame(rows, "doc_id long, index int, antecedent int, key string")
    assert {tuple(r) for r in citation_counts(c).collect()} == {("a", 6, 3), ("b", 1, 1), ("c", 2, 1)}


def test_resolve_with_extents_reads_each_text_once(spark):
    import re
    import sys

    rows = [(i, f"Alder v Birch, 41 DLR (4th) {i}. Alder, supra at {i + 30}. Alder, supra at {i + 29}.") for i in range(1, 9)]
    found = extract(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = spark.createDataFrame([(f"4:reporter:dlr:dlr4th:41:{i}", i + 29, None) for i in range(1, 9) if i != 5], "key string, last_page int, paragraphs int")
    module, got = sys.modules["citeloom.operators.extract"], []
    for few in (module.FEW, 2):  # sent to all, and joined by shuffles
        before, module.FEW = module.FEW, few
        try:
            r = resolve(found, extents=sizes)
        finally:
            module.FEW = before
        got.append(sorted((x["doc_id"], x["index"], x["antecedent"]) for x in r.collect()))
        plan = r._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall("MapInArrow", plan)) == 2  # one reads, one resolves
    assert got[0] == got[1] == sorted((i, k, 0 if k == 2 or i == 5 else None) for i in range(1, 9) for k in (1, 2))


def test_note_queries_make_only_what_they_select(spark):
    from citeloom.plans.queries import QUERIES

    for name in ("ibid_across_notes", "supra_note_and_name", "supra_out_of_range"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        made = next(x for x in plan.splitlines() if "MapInArrow" in x)
        assert "antecedent_reason" in made and "interpretations" not in made and "url" not in made, name


def test_note_queries_read_where_the_texts_are(spark):
    """Notes are made beside their text: no join, no window, and of the fields only the note."""
    from citeloom.plans.queries import QUERIES

    for name in ("ibid_across_notes", "supra_note_and_name", "supra_out_of_range"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan, name
    assert extract(spark.createDataFrame([(1, "x")], "doc_id long, text string"), columns=("fields.note",)).schema["fields"].dataType.names == ["note"]


def test_notes_of_a_column_are_those_of_a_table(spark, monkeypatch):
    import sys

    monkeypatch.setattr(sys.modules["citeloom.operators.extract"], "SLICE", 3)
    kind = "array<struct<number:int,start:int,end:int,sequence:int>>"
    texts = [(i, "R v A, 2016 SCC 1. | Ibid." + " | supra note 1." * (i % 4), [(1, 0, 19, 0), (2, 20, 26, 0)][: i % 3] if i % 5 else None) for i in range(40)]
    d = spark.createDataFrame(texts, f"doc_id long, text string, notes {kind}").coalesce(2)
    n = d.selectExpr("doc_id", "inline(notes)")
    assert sorted(map(repr, extract(d, "notes").collect())) == sorted(map(repr, extract(d, n).collect()))


def test_workers_pass_citations_on(spark, monkeypatch):
    """Python workers hold a bounded number of citations, however many texts a batch has."""
    import sys

    module = sys.modules["citeloom.operators.extract"]
    monkeypatch.setattr(module, "HELD", 3)
    d = spark.createDataFrame([(i, "2016 SCC 27; 2016 SCC 28") for i in range(20)], "doc_id long, text string").coalesce(1)
    assert extract(d).count() == 40


def test_notes_bound_citations(spark):
    text = "R v A, 2016 SCC 1. | Ibid."
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    n = spark.createDataFrame([(1, 1, 0, 19, 0), (1, 2, 20, 26, 0)], "doc_id long, number int, start int, end int, sequence int")
    assert [r["antecedent_reason"] for r in extract(d, n).where("form = 'ibid'").collect()] == ["ibid_previous_note"]


def test_readers(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"text": "2016 SCC 27", "note": 3}\n\n"R v X"\n')
    got = readers.json_lines(spark, str(p)).orderBy("line").collect()
    assert [(r["line"], r["text"]) for r in got] == [(1, "2016 SCC 27"), (3, "R v X")]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"x": 1}\n')
    with pytest.raises(Exception, match="line 1"):
        readers.json_lines(spark, str(bad)).collect()
    assert readers.json_lines(spark, str(bad), strict=False).collect()[0]["text"] is None
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert readers.text_files(spark, str(tmp_path / "t.txt")).collect()[0]["text"] == "one\ntwo"
    lines = spark.createDataFrame([('{"id": 1, "method": "keyForText", "request": {"text": "2016 SCC 27"}}',), ("nonsense",), ('{"id": 2, "method": "none"}',)], "value string")
    got = readers.batch(lines, api.call).collect()
    assert json.loads(got[0]["result"])["key"] == "4:neutral:2016:scc:27" and got[1]["error"] and got[2]["id"] == "2" and got[2]["error"]
    readers.write_json(lines, str(tmp_path / "out"))


def test_streaming_equals_batch(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/in")
    stream_extract(stream_documents(spark, f"{tmp_path}/in", files_per_trigger=1), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(map(repr, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(repr, extract(docs).collect()))


def test_sql_functions(spark):
    api.register(spark)
    r = spark.sql("SELECT cite_key_for_text('R v J, 2016 SCC 27') k, cite_case_name('R. v. Jordan') n, cite_call('hasCitation', '{\"text\": \"x\"}') h, cite_key_for_text(NULL) z").first()
    assert tuple(r) == ("4:neutral:2016:scc:27", "R v Jordan", "false", None)


def test_registry(spark):
    ids = [r["id"] for r in registry.SEED.courts]
    assert len(ids) == len(set(ids))
    known = {j["id"] for j in registry.SEED.jurisdictions}
    assert all(r["jurisdiction"] in known for t in ("courts", "reporters", "series", "journals") for r in registry.SEED.tables()[t])
    assert all(r["court"] in ids for r in registry.SEED.reporters if r["court"])
    s = registry.surfaces(spark, "codes")
    assert {r["id"] for r in s.where("surface = 'fca'").collect()} == {"fca", "fca-au"}


def test_plans_stay_native(spark):
    from citeloom.plans.queries import QUERIES

    for name in ("find_neutral", "key_neutral", "key_statute", "find_reporter_year_volume", "annotate_core", "anchor_overlap_greedy"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_aliases(spark):
    from citeloom.operators.aliases import apply_aliases, chapter_twins, closed_groups

    c = spark.createDataFrame([("a", "2016 SCC 27", "scc"), ("b", "[2016] 1 SCR 631", "scc"), ("c", "[2016] 1 SCR 631", "onca"), (None, "x", None)], "key string, core string, court string")
    a = spark.createDataFrame([("a", "K1", None), ("[2016] 1 S.C.R. 631", "K2", "scc")], "written string, key string, court string")
    assert [r["alias_key"] for r in apply_aliases(c, a).orderBy("core", "court").collect()] == ["K1", "c", "K2", None]
    g = spark.createDataFrame([(0, ["x", "y"]), (1, ["y", "x"]), (2, ["y", "z"]), (3, ["w"])], "index int, keys array<string>")
    assert sorted(map(tuple, closed_groups(g).collect())) == [(0, 0, True), (1, 0, True), (2, 2, True), (3, 3, False)]
    t = spark.createDataFrame([(1, "RSC", "1985", "C-10"), (1, "RSC", "1985", "C-10"), (1, "RSC", "1985", "C-1O"), (1, "RSC", "1985", "D-1"), (1, "RSC", "1985", "D-l")], "doc_id long, series string, year string, chapter string")
    assert sorted(r["read"] for r in chapter_twins(t).collect()) == ["C-10", "C-10", "C-10", "D-1", "D-l"]
