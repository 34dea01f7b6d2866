"""Operators against small models and edge cases: nulls, ties, empty tables."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars as C
from weftline.functions import script as S
from weftline.operators import audit, cases, edges, relational, retrieval, rules, tokens, traverse
from weftline.sources import files, store
from weftline.streaming import events as stream

TOKENS = "token_sha string, module string, page_url string, section string, paragraph int, content_type string, content string"
EDGES = "source_sha string, target_sha string, rel_type string, weight double"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_modulo_follows_the_divisor(spark):
    for a, b in ((7, 3), (-7, 3), (7, -3), (-7, -3)):
        assert one(spark, S.modulo(F.lit(a), F.lit(b)))[0] == a % b


def test_equality_is_null_safe_and_order_coerces(spark):
    null = F.lit(None).cast("string")
    assert one(spark, S.same(null, null), S.less(F.lit("x"), F.lit("3")), S.less(null, F.lit(1)), S.joined(null, F.lit(2.0))) == (True, True, True, "2.0")


def test_division_by_zero_in_assignments(spark):
    got = one(spark, S.assigned(F.lit(5), "/=", F.lit(0)), S.assigned(F.lit(5), "%=", F.lit(0)), S.assigned(F.lit(5), "-=", F.lit(None)))
    assert tuple(got) == (0.0, 0.0, 5.0)


def test_truth(spark):
    got = one(spark, S.truthy(F.lit(""), "text"), S.truthy(F.lit(None).cast("int"), "number"), S.truthy(F.array(), "container"), S.truthy(F.lit(-1), "number"))
    assert tuple(got) == (False, False, False, True)


@pytest.mark.parametrize(("text", "number"), [(" 12 ", 12.0), ("1e5", 0.0), ("x", 0.0), ("-3.5", -3.5), ("", 0.0)])
def test_to_number(spark, text, number):
    assert one(spark, S.to_number(F.lit(text)))[0] == number


def test_every_scalar_family_runs(spark):
    text = one(spark, C.TEXT["removeLastOccurence"](F.lit("abcab"), "b"), C.TEXT["matches"](F.lit("abc"), "b"), C.TEXT["lastIndexOf"](F.lit("abcab"), "ab"), C.TEXT["isBlank"](F.lit(" \t")))
    assert tuple(text) == ("abca", False, 3, True)
    days = one(spark, C.DATE["addBusinessDay"](F.lit("2024-03-01").cast("date"), 1), C.DATE["addBusinessDay"](F.lit("2024-03-04").cast("date"), -1))
    assert [str(x) for x in days] == ["2024-03-04", "2024-03-01"]
    assert one(spark, C.MAP["put"](F.create_map(F.lit("a"), F.lit(1)), "a", F.lit(2)))[0] == {"a": 2}
    assert one(spark, C.LIST["remove"](F.array(F.lit(1), F.lit(2)), 0))[0] == [2]
    assert one(spark, C.ACCESS["Like"](F.lit("small ring"), "s*ring"))[0]


def test_dml(spark):
    form = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    assert relational.deleted(form, F.col("s") == "a").count() == 1
    assert {r.s for r in relational.updated(form, F.col("s") == "a", {"s": F.lit("b")}).collect()} == {"b", None}


PAGE = "# T\nalpha\nbeta\n\n**Note:** see\n\n```\n# no heading?\n\ncode\n```\nvoid f(a, b)\nx | y\n\na | b\n"


def test_paragraphs_follow_headings_fences_and_blanks(spark):
    got = tokens.tokens(spark.createDataFrame([("m", "u", PAGE)], "module string, page_url string, body string")).orderBy("paragraph").collect()
    assert [(r.section, r.content_type, r.content) for r in got][:2] == [("T", "PROSE", "alpha\nbeta"), ("T", "NOTE", "**Note:** see")]
    assert [r.content_type for r in got][-1] == "CODE_EXAMPLE"  # the heading broke the fence, whose end opens another
    assert any(r.section == "no heading?" for r in got)  # headings split inside fences too
    assert [r.paragraph for r in got] == list(range(len(got)))


def test_classes(spark):
    kinds = {"a | b\n\nc | d": "TABLE_ROW", "string f(x)": "SIGNATURE", "> __Pro Tip__: x": "PRO_TIP", "**Very Important:** x": "VERY_IMPORTANT", "```\nx\n```": "CODE_EXAMPLE", "": "PROSE"}
    got = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", tokens.content_type(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == kinds


def test_pages_without_text(spark):
    got = tokens.tokens(spark.createDataFrame([("m", "u", ""), ("m", "v", None)], "module string, page_url string, body string"))
    assert got.count() == 0


def test_as_of_is_strict(spark):
    rng = random.Random(3)
    rows = [(f"t{i}", "m", "u", "s", rng.randrange(12), rng.choice(["PROSE", "NOTE", "CODE_EXAMPLE"]), "x") for i in range(40)]
    got = {(r.source_sha, r.target_sha) for r in edges.callouts(spark.createDataFrame(rows, TOKENS)).collect()}
    at = {r[0]: (r[4], r[5]) for r in rows}
    for sha, (place, kind) in at.items():
        if kind == "NOTE":
            before = [p for p, k in at.values() if k != "NOTE" and p < place]
            found = [s for s, t in got if t == sha]
            assert len(found) == bool(before)
            if found:
                assert at[found[0]][0] == max(before)


def graph(spark, pairs):
    return spark.createDataFrame([(a, b, "R", 1.0) for a, b in pairs], EDGES)


def test_bfs_and_reachability(spark):
    rng = random.Random(5)
    pairs = [(str(rng.randrange(30)), str(rng.randrange(30))) for _ in range(50)]
    depth, front, level = {"0": 0}, ["0"], 0
    while front:
        level += 1
        front = sorted({b for a, b in pairs if a in front} - depth.keys())
        depth |= dict.fromkeys(front, level)
    got = traverse.bfs(graph(spark, pairs), spark.createDataFrame([("0",)], "node string"))
    assert {r.node: r.depth for r in got.collect()} == depth


def test_pagerank_drops_dangling_rank(spark):
    pairs = [("a", "b"), ("a", "b"), ("b", "c"), ("d", "c"), ("c", "a"), ("a", "e")]
    nodes = sorted({x for p in pairs for x in p})
    rank = dict.fromkeys(nodes, 1 / 5)
    for _ in range(20):
        new = dict.fromkeys(nodes, 0.15 / 5)
        for a, b in pairs:
            new[b] += 0.85 * rank[a] / sum(x == a for x, _ in pairs)
        rank = new
    got = traverse.pagerank(graph(spark, pairs), spark.createDataFrame([(n,) for n in nodes], "node string"))
    for r in got.collect():
        assert math.isclose(r["rank"], rank[r.node], abs_tol=1e-12)


def test_pagerank_ends_where_ranks_stay(spark, monkeypatch):
    pairs = [("s", "p"), ("s", "q"), ("p", "c"), ("q", "c"), ("q", "c"), ("q", "d")]
    nodes = spark.createDataFrame([(n,) for n in "spqcd"], "node string")
    cuts = []
    monkeypatch.setattr(traverse, "cut", lambda df, real=traverse.cut: (cuts.append(1), real(df))[1])
    got = {r.node: r["rank"] for r in traverse.pagerank(graph(spark, pairs), nodes, rounds=100).collect()}
    base = 0.15 / 5
    p = base + 0.85 * base / 2
    assert got == pytest.approx({"s": base, "p": p, "q": p, "c": base + 0.85 * (p + p * 2 / 3), "d": base + 0.85 * p / 3}, abs=1e-12)
    assert len(cuts) <= 7


def test_load_order_and_cycles():
    assert traverse.load_order([("c", "b"), ("b", "a"), ("d", "a")]) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError, match="cycle"):
        traverse.load_order([("a", "b"), ("b", "a")])


def test_word_budget_stops_at_the_first_overflow(spark):
    rng = random.Random(7)
    for budget in (1, 5, 9):
        rows = [(f"t{i}", float(rng.randrange(5)), i, "w " * rng.randrange(1, 6)) for i in range(8)]
        want, used = [], 0
        for r in sorted(rows, key=lambda r: (-r[1], r[2])):
            n = len(r[3].split())
            if used + n > budget and want:
                break
            want.append(r[0])
            used += n
        got = retrieval.within_budget(spark.createDataFrame(rows, "token_sha string, score double, line int, content string"), budget)
        assert sorted(r.token_sha for r in got.collect()) == sorted(want)


def test_rules_fire_once_each(spark):
    rows = [("x" * 256, "maybe", "R100", "Lost"), ("ok", "-1", "12x", "Open"), (None, "", "1,000", None)]
    table = spark.createDataFrame([(i + 2, *r) for i, r in enumerate(rows)], "line int, A string, B string, C string, Status string")
    found = rules.value_rules(rules.cells(table, "f.csv", F.col("line"), {"A": "TEXT", "B": "BIT", "C": "CURRENCY", "Status": "TEXT"}), ["Open"])
    assert sorted(r.rule for r in found.collect()) == ["VD010", "VD012", "VD013", "VD014", "VD015", "VD020"]
    assert rules.exit_code(found).first()[0] == 2
    assert rules.exit_code(found.filter("false")).first()[0] == 0


def test_broken_references(spark):
    t = spark.createDataFrame([("a", "m", "u", "", 0, "PROSE", "x")], TOKENS)
    e = spark.createDataFrame([("a", "z", "CROSS_MODULE", 1.0), ("a", "a", "HIERARCHY", 1.0)], EDGES)
    assert [r.target_sha for r in audit.broken_references(t, e).collect()] == ["z"]
    assert audit.orphan_tokens(t, e).count() == 0


def test_store(spark):
    t = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "token_sha string, weight double")
    kept, refused = store.insert_tokens(t, spark.createDataFrame([("b", 5.0), ("c", 3.0), ("c", 3.0)], t.schema))
    assert sorted(r.token_sha for r in kept.collect()) == ["a", "b", "c"]
    assert sorted(r.token_sha for r in refused.collect()) == ["b", "c"]
    none = spark.createDataFrame([], EDGES)
    added = store.insert_edges(none, spark.createDataFrame([("a", "b", "R", 1.0), ("a", "b", "R", 1.0), ("a", "z", "R", 1.0)], EDGES), t)
    assert added.count() == 1
    assert store.upsert(t, spark.createDataFrame([("a", 9.0)], t.schema), "token_sha").orderBy("token_sha").first().weight == 9.0


def test_batches_keep_order_and_size(spark):
    out = store.batches(spark.range(1001), ["id"], F.col("id"), 200).orderBy("batch").collect()
    assert [r.n_records for r in out] == [200] * 5 + [1]
    assert sum((eval(r.payload) for r in out), []) == list(range(1001))


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two, 2"\n,\n')
    rows = files.csv(spark, str(tmp_path / "a.csv"), ["x", "y"])
    assert [r.record for r in files.for_upload(rows, []).collect()] == [{"x": "1", "y": "two, 2"}]
    assert files.keys(rows, "x").count() == 1
    (tmp_path / "md").mkdir()
    (tmp_path / "md/p.md").write_text('---\nurl: "http://a/b"\ntitle: T\n---\n# H\ntext\n')
    page = files.markdown(spark, str(tmp_path / "md")).first()
    assert page.front == {"url": "http://a/b", "title": "T"}
    assert page.body == "# H\ntext\n"


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    live = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001/")
    q = stream.tumbling(live).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select * from windows").collect())) == sorted(map(tuple, stream.tumbling(table).collect()))
    q = stream.checked(live, lambda b: rules.diagnosed(b.select(F.lit("e").alias("file"), F.col("event_id").cast("int").alias("line"), "value"), [("V", "INFO", F.col("value") > 50, F.lit("high"))]), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == table.filter("value > 50").count()


def test_imports_do_not_need_llm():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "weftline"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "weftline.llm" not in path.read_text()


def test_index_counts_shuffle_contents_not_terms(spark):
    rows = [("a", "One two one"), ("b", "two, TWO; été2"), ("a", "one"), ("c", None), ("d", "—")]
    t = spark.createDataFrame(rows, "token_sha string, content string")
    counts = retrieval.term_counts(t)
    assert {(r.term, r.token_sha): r.tf for r in retrieval.postings(counts).collect()} == {("one", "a"): 3, ("two", "a"): 1, ("two", "b"): 2, ("été2", "b"): 1}
    index = retrieval.postings(cases.updated_counts(counts, t.filter("token_sha in ('b', 'none')"), spark.createDataFrame([("b", "new new"), ("e", "one")], t.schema)))
    assert {(r.term, r.token_sha): r.tf for r in index.collect()} == {("one", "a"): 3, ("two", "a"): 1, ("new", "b"): 2, ("one", "e"): 1}
    plan = retrieval.postings(counts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate")
