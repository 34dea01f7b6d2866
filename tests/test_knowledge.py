"""Markdown, cases, edges, scripts and sources against plain Python on small inputs; and the package without its corpus part."""

from __future__ import annotations

import itertools
import os
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars
from weftline.operators import cases, edges, markdown, retrieval, rules, scripts
from weftline.sources import files, store

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_markdown_of_nested_tags(spark):
    page = '<h2>A &amp; b</h2><p>one <b>two</b><a href="/x">li<i>nk</i></a><ul><li>a<ul><li>b</li></ul></li></ul><pre><code>x &lt; y</code></pre><div class="a note">see</div><table><tr><td>1</td><td>2</td></tr></table><!-- gone --><a href="q">lost'
    rows = {r.k: r.markdown for r in markdown.to_markdown(spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, html string"), "k").collect()}
    assert rows[1] == "## A & b\n\none **two****[link](/x)\n- a\n  - b\n```\nx < y\n```\n\n> see\n| 1 | 2 |\n"
    assert rows[2] == rows[3] == "\n"


def test_near_cases_lose_no_pair(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.left_id, r.right_id): r.share for r in retrieval.near_cases(docs.filter("id % 3 = 0"), docs).collect()}
    sets = [set(t.split()) for t in texts]
    want = {(i, j): len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) for i, j in itertools.product(range(0, 120, 3), range(120)) if i != j and sets[i] and sets[j]}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0.6})


def test_near_cases_of_many_blocks_shuffle_no_pairs(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("BLOCK_WORDS", 150), ("DENSE", 3), ("CELLS", 40)):
        monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i * i // 9}" for i in range(20)], k=rng.randrange(0, 14))) for _ in range(90)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "w0")], "id long, text string")
    found = retrieval.near_cases(docs.filter("id % 2 = 0"), docs)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    sets = [set(t.split()) for t in texts]
    want = {(i, j): len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) for i, j in itertools.product(range(0, 90, 2), range(90)) if i != j and sets[i] and sets[j]}
    assert {(r.left_id, r.right_id): r.share for r in found.collect()} == {k: v for k, v in want.items() if v > 0.6}


def test_near_cases_of_sets_of_all_sizes(monkeypatch):
    """Sets under and over ``DENSE`` words, with frequent words and without: the pairs of a brute-force count, and few words met for those that share little."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    often, seldom = [f"o{i}" for i in range(40)], [f"s{i}" for i in range(3000)]
    sets = [set(rng.sample(often, rng.randrange(0, 25))) | set(rng.sample(seldom, rng.choice([0, 1, 5, 30, 60, 200]))) for _ in range(300)]
    sets += [set(rng.sample(sorted(s), max(1, int(len(s) * rng.uniform(0.4, 1))))) | set(rng.sample(seldom, rng.randrange(40))) for s in sets if s]

    def block(some):
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in some]), pa.array([" ".join(sorted(s)) for _, s in some])], ["id", "words"])
        row = next(retrieval._block(0.6)(iter([batch])))
        return {n: row.column(n)[0].values for n in row.schema.names}

    gathered, met = retrieval._gathered, []
    monkeypatch.setattr(retrieval, "_gathered", lambda *x: (met.append(out := gathered(*x)), out)[1])
    left, right = list(enumerate(sets))[::3], list(enumerate(sets))
    a, b = block(left), block(right)
    got = {(a["id"][i].as_py(), b["id"][int(k)].as_py()): x for i, j, share in retrieval._counted(a, b, 0.6) for k, x in zip(j, share, strict=True)}
    want = {(i, j): len(s & t) / min(len(s), len(t)) for i, s in left for j, t in right if s and t}
    assert got == {k: v for k, v in want.items() if v > 0.6}
    assert sum(map(len, met)) < sum(len(s & t) for _, s in left for _, t in right) / 2
    assert next(retrieval._block(0.6)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([""])], ["id", "words"])])), None) is None
    looked, least = retrieval._needed(np.arange(1, 500), 0.6)
    assert all(any(k / n > 0.6 for k in range(n + 1)) and n - looked[n - 1] + least[n - 1] == min(k for k in range(n + 1) if k / n > 0.6) for n in range(1, 500))


def test_near_ids_are_those_of_the_pairs(spark, monkeypatch):
    """In one round and in two; cases of the same known words are looked up once, and a case's own text among the known ones doesn't count."""
    rng = random.Random(11)
    texts = [" ".join(rng.choices([f"w{i * i // 4}" for i in range(40)], k=rng.randrange(0, 14))) for _ in range(90)]
    docs = [*enumerate(texts), *((100 + i, f"case {i} of its own kind") for i in range(30)), (200, "alone here"), (201, "twin of nobody else"), (202, "twin of nobody else"), (None, "w0"), (203, None)]
    df = spark.createDataFrame(docs, "id long, text string")
    known = df.filter("id < 60 or id >= 200 and id < 202")
    want = {r.left_id for r in retrieval.near_cases(df, known).select("left_id").distinct().collect()}
    assert 202 in want and 200 not in want and 201 not in want and 100 not in want
    assert sorted(r.id for r in retrieval.near_ids(df, known).collect()) == sorted(want)
    for name, value in (("BLOCK_ROWS", 8), ("BLOCK_WORDS", 150)):
        monkeypatch.setattr(retrieval, name, value)
    assert sorted(r.id for r in retrieval.near_ids(df, known).collect()) == sorted(want)


def test_edges_in_one_pass_are_those_of_the_parts(spark):
    rng = random.Random(4)
    rows = [(f"t{i}", f"p{rng.randrange(3)}", f"s{rng.randrange(2)}", i // 2, rng.choice(["PROSE", "NOTE", "CODE_EXAMPLE", "PRO_TIP", "TABLE_ROW"])) for i in range(60)]
    t = spark.createDataFrame(rows, "token_sha string, page_url string, section string, paragraph int, content_type string")
    parts = [f(t) for f in (edges.hierarchy, edges.siblings, edges.callouts, edges.examples)]
    want = {tuple(r) for p in parts for r in p.collect()}
    got = [tuple(r) for r in edges.infer(t).collect()]
    assert set(got) == want
    assert len(got) == len({g[:3] for g in got})


def test_bm25_cuts_the_query_as_the_index(spark):
    t = spark.createDataFrame([("a", "fn1(x) calls fn2"), ("b", "nothing here"), ("c", None)], "token_sha string, content string")
    assert [r.token_sha for r in retrieval.bm25(t, "FN1(").collect()] == ["a"]
    assert retrieval.bm25(t, "  ").count() == 0


def test_premises_by_sha_word_and_lost_edges(spark):
    t = spark.createDataFrame([("aaaaaaaa1", "m", "u", "", 0, "Some Words"), ("bbbbbbbb2", "m", "v", "", 0, "more words")], "token_sha string, module string, page_url string, section string, paragraph int, content string")
    e = spark.createDataFrame([("gone", "aaaaaaaa1"), ("bbbbbbbb2", "gone")], "source_sha string, target_sha string")
    asked = spark.createDataFrame([(x,) for x in ("aaaaaaaa1", "m.root.p0", "m.root.p0_bbbbbbbb", "WORDS", "gone", "never")], "entity string")
    got = {r.entity: r.answer for r in cases.ask(asked, t, e).collect()}
    assert got == {"aaaaaaaa1": "true", "m.root.p0": "true", "m.root.p0_bbbbbbbb": "true", "WORDS": "mentioned_in_aaaaaaaa", "gone": "connected_via_2_edges", "never": None}


def test_comments_stop_outside_of_strings(spark):
    rows = [('u = "http://x"; // note', 'u = "http://x"; '), ("a / b // c", "a / b "), ('open "http://x', 'open "http://x'), ("// all", ""), ("plain", "plain")]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "t string").select(scripts.stripped(F.col("t"))).collect()]
    assert got == [b for _, b in rows]


def test_numbers_in_words(spark):
    want = {0: "zero", 7: "seven", 20: "twenty", 45: "forty-five", 100: "one hundred", 115: "one hundred fifteen", 2000: "two thousand", 1_000_001: "one million one", -12: "minus twelve"}
    rows = spark.createDataFrame([(k,) for k in want], "n long").select("n", scalars.MATH["toWords"](F.col("n")).alias("w")).collect()
    assert {r.n: r.w for r in rows} == want


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "claims.csv").write_text('ID,Note\n1,"two\nlines"\n2,\n3,x\n')
    rows = files.numbered_csv(spark, str(tmp_path / "in"), ["ID", "Note"]).collect()
    assert [(r.file, r.line, r.ID) for r in sorted(rows, key=lambda r: r.line)] == [("claims.csv", 2, "1"), ("claims.csv", 3, "2"), ("claims.csv", 4, "3")]
    assert files.preview(spark, str(tmp_path / "in"), ["ID", "Note"], 2).count() == 2
    found = files.file_rules(spark.createDataFrame([("claims.csv", "ID"), ("odd.csv", "ID"), ("depts.csv", " ")], "file string, header string"), ["claims", "depts"])
    assert sorted((r.file, r.rule) for r in found.collect()) == [("depts.csv", "VD002"), ("odd.csv", "VD001")]
    one = spark.createDataFrame([(1, 2.5, True)], "ID int, x double, ok boolean")
    order = files.export_tables({"claims": one, "depts": one, "MSysObjects": one, "audit": one}, [("claims", "depts")], str(tmp_path / "out"))
    assert order == ["depts", "claims", "audit"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "depts")).first().asDict() == {"ID": "1", "x": "2.5", "ok": "true"}
    batches = store.ordered_batches({"depts": one, "claims": one.union(one)}, ["depts", "claims"], "ID", 1).orderBy("place", "batch").collect()
    assert [(b.table_name, b.batch, b.n_records) for b in batches] == [("depts", 0, 1), ("claims", 0, 1), ("claims", 1, 1)]
    left, n = store.purged(one)
    assert (left.count(), n) == (0, 1)


def test_rejected_repeats_are_the_later_ones(spark):
    new = spark.createDataFrame([("a", "z"), ("a", "b"), ("c", "d")], "token_sha string, content string")
    kept, refused = store.insert_tokens(new.filter("false"), new)
    assert sorted(map(tuple, kept.collect())) == [("a", "b"), ("c", "d")]
    assert [tuple(r) for r in refused.collect()] == [("a", "z")]


def test_the_rest_works_without_the_corpus_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(k.startswith('op') for k in q))"], cwd=copy, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
    n, with_sql, corpus = out.stdout.split()[-3:]
    assert int(n) >= int(with_sql) > 100
    assert corpus == "False"


def test_numbers_with_exponents(spark):
    from weftline.functions import script

    rows = spark.createDataFrame([(x,) for x in ("1.5e3", "1e3", "2.E-1", ".5e1", "1.5e", "7", "-0.5", "x", None)], "t string")
    got = [r[0] for r in rows.select(script.to_number(F.col("t"))).collect()]
    assert got == [1500.0, 0.0, 0.2, 5.0, 0.0, 7.0, -0.5, 0.0, 0.0]


def test_repeated_edges_leave_nothing_to_chance(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "token_sha string")
    schema = "source_sha string, target_sha string, rel_type string, weight double"
    there = spark.createDataFrame([("b", "a", "X", 0.9)], schema)
    new = spark.createDataFrame([("a", "b", "X", 0.7), ("a", "b", "X", 0.2), ("b", "a", "X", 0.1), ("a", "gone", "X", 0.5)], schema).repartition(3)
    assert sorted(map(tuple, store.insert_edges(there, new, keys).collect())) == [("a", "b", "X", 0.2), ("b", "a", "X", 0.9)]


@pytest.mark.parametrize("text,want", [
    ("x = f(a, g(b, c), [1, 2], {\"k, v\": 3});", [("g", ["b", "c"]), ("f", ["a", "g(b, c)", "[1, 2]", "{\"k, v\": 3}"])]),
    ("f()", [("f", [])]), ("if (a == b(1)) {", [("b", ["1"]), ("if", ["a == b(1)"])]), ("f(a, g(b)", [("g", ["b"])]), ("(a, b) )", []), ("", []), ("s = \"f(a, b)\" + h(\"(,\", x )", [("h", ["\"(,\"", "x"])]),
    ("T = IfNull(v.get(\"t\"), 500.0)", [("get", ["\"t\""]), ("ifnull", ["v.get(\"t\")", "500.0"])]),
])
def test_calls_follow_brackets(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(scripts.calls_of(F.col("t"))).first()[0]
    assert [(c.name, c.args) for c in got] == want


def test_thresholds_of_assignments_and_fallbacks(spark):
    lines = ["Threshold_a = 500;", "v = ifnull(x.get(1, 2), 700); // threshold", "threshold = ifnull(f(a, b), 700)", "threshold = 999.99", "other = 3", "my.threshold=12.5.1", "a = b.threshold1 = 7"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(lines, 1)], "file string, line int, text string")
    none = spark.createDataFrame([], "function string, n_params int")
    got = sorted((r.line, r.message) for r in scripts.file_rules(df, [], ["none"], none).filter("rule = 'DG014'").collect())
    assert got == [(1, "threshold 500.0"), (3, "threshold 700.0")]


@pytest.mark.parametrize("seed", range(4))
def test_guard_scopes_by_a_stack(spark, seed):
    rng = random.Random(seed)
    kinds = ["if (v != null) {", "if (w == null) { return; }", "if (x > 1) {", "}", "}}", "a = v.f;", "b = w.g;", "if (v == null) { v.f }", "// }", "c = 1;"]
    rows = [(f"f{f}", i, t) for f in range(12) for i, t in enumerate(["v = F[a == 1];", "w = G[b];", *rng.choices(kinds, k=14)], 1)]
    want = set()
    for f in range(12):
        depth, open_, said = 0, [], set()
        for _, i, t in (r for r in rows if r[0] == f"f{f}"):
            t = t.split("//")[0]
            depth += t.count("{") - t.count("}")
            open_ = [(v, d) for v, d in open_ if depth >= d]
            for v in ("v", "w"):
                if f"{v} != null" in t or f"{v} == null" in t:
                    open_.append((v, depth))
                if f"{v}." in t and v not in said and all(o != v for o, _ in open_):
                    said.add(v)
                    want.add((f"f{f}", i, f"no null check of {v}"))
    none = spark.createDataFrame([], "form string, field string, parent string")
    found = scripts.variable_rules(spark.createDataFrame(rows, "file string, line int, text string"), none.select("form", "field"), none)
    assert {(r.file, r.line, r.message) for r in found.filter("rule = 'DG005'").collect()} == want


def _broadcast_joins(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


def test_variable_rules_send_no_lines_to_the_driver(spark, tmp_path):
    spark.range(20).selectExpr("concat('f', id) as file").write.parquet(str(tmp_path / "f"))
    text = F.explode(F.array(*map(F.lit, ("v = Depts[ID == 1];", "if (v != null) {", "x = v.Nope;", "}", "y = v.Title;"))))
    lines = spark.read.parquet(str(tmp_path / "f")).select("file", text.alias("text")).withColumn("line", F.when(F.col("text").startswith("v"), 1).when(F.col("text").startswith("if"), 2).when(F.col("text").contains("Nope"), 3).when(F.col("text") == "}", 4).otherwise(5))
    fields, keys = spark.createDataFrame([("Depts", "Title")], "form string, field string"), spark.createDataFrame([("Claims", "dept", "Depts")], "form string, field string, parent string")
    found = scripts.variable_rules(lines, fields, keys)
    assert not [j for j in _broadcast_joins(found) if "file#" in j]
    assert sorted({(r.line, r.rule, r.message) for r in found.collect()}) == [(3, "DG024", "Depts.Nope"), (5, "DG005", "no null check of v")] and found.count() == 40


def test_related_tokens_are_cut_by_term_before_cases_meet_them(spark):
    tokens = spark.createDataFrame([(f"t{i}", "NOTE" if i % 2 else "PROSE", f"Fn1 fn1 word{i} {'odd' if i % 2 else 'even'}") for i in range(9)], "token_sha string, content_type string, content string")
    asking = spark.createDataFrame([(1, "FN1"), (2, "fn1"), (3, "odd"), (3, "even"), (4, "nowhere"), (5, None)], "id int, query string")
    found = cases.related(asking, tokens, 3)
    assert "windowspecdefinition(term#" in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.id, r.target_sha, r.weight) for r in found.collect())
    weight = lambda i: 0.7 if i % 2 else 0.95
    assert got == [(k, f"t{i}", weight(i)) for k in "123" for i in range(3)]


def test_file_rules_read_calls_where_calls_are(spark, tmp_path):
    text = ["threshold = 5; // 7", "x = ifnull(threshold, 12); // ifnull(threshold, 13)", "y = fn1(fn1(a, b, c), 1);", "alert \"//\";", "z = zoho.lost + zoho.bad + zoho.bad;", None]
    spark.createDataFrame([("custom_api/f", i, t) for i, t in [*enumerate(text), (0, text[0])]], "file string, line int, text string").write.parquet(str(tmp_path / "l"))
    found = scripts.file_rules(spark.read.parquet(str(tmp_path / "l")), [], ["zoho.bad"], spark.createDataFrame([("fn1", 2)], "function string, n_params int"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 4
    want = [(0, "DG014", "threshold 5.0"), (1, "DG014", "threshold 12.0"), (1, "DG020", "no response map"), (2, "DG025", "fn1 3 of 2"), (3, "DG021", "form task alert"), (4, "DG002", "banned zoho.bad"), (4, "DG002", "banned zoho.bad"), (4, "DG018", "unknown zoho.lost")]
    assert sorted((r.line, r.rule, r.message) for r in found.collect()) == want


def test_builder_and_reference_rules_shuffle_no_frequent_name(spark):
    lines = spark.range(30).selectExpr("concat('f', id) as file", "1 as line", "if(id = 3, 'insert into Lost [ x = input.b ]', 'insert into Known [ x = input.a ]') as text")
    fields = spark.createDataFrame([("F", "A", "text", "")], "form string, field string, kind string, choices string")
    found = scripts.builder_rules(lines, fields, spark.createDataFrame([("Known",)], "form string"))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.file, r.rule) for r in found.collect()] == [("f3", "DS003")]
    names = [spark.createDataFrame([(x,) for x in xs], "field string") for xs in (("a", "b"), ("a", "gone"))]
    refs = rules.reference_rules(rules.input_references(lines), *names)
    assert refs._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") <= 1  # of the unused names, each once
    assert sorted((r.file, r.rule, r.message) for r in refs.collect()) == [("f3", "HY014", "b"), ("scripts", "HY015", "gone")]
