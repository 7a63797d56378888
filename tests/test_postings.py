"""The stored postings, the dictionary's keys and the first k of many queries."""

import random
import re

import pytest
from pyspark.sql import functions as F

from onomast.functions import analysis as an
from onomast.operators import bulk_match, name_search
from onomast.plans.name_query import NameQuery
from onomast.sources import postings as ps
from onomast.sources.schema import index
from tests.test_name_search import PEOPLE, SYN


def distance(a, b):
    """Edit distance with exchanged neighbours as one edit, no letter edited twice."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def brute(patterns, terms):
    out = set()
    for p, kind in patterns:
        if kind == "wild":
            rule = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p), re.S)
            out |= {(p, kind, t, 1.0) for t in terms if rule.fullmatch(t)}
            continue
        most = 2 if len(p) > 8 else 1
        met = [(round(1 - d / min(len(t), len(p)), 9), t) for t in terms if t[:2] == p[:2] for d in [distance(t, p)] if d <= most]
        out |= {(p, kind, t, w) for w, t in sorted((x for x in met if x[0] > 0), key=lambda x: (-x[0], x[1]))[:50]}
    return out


def test_dictionary_equals_brute_force(spark):
    r = random.Random(3)
    words = {"".join(r.choice("abcé") for _ in range(r.randint(1, 11))) for _ in range(1500)} | {"smith", "smyth", "mitten", "a%b_c", "a\\b", "washington", "wahsingtno", "wasxxxton", "ab", "a"}
    words |= {f"commonpre{a}{b}" for a in "abcdefgh" for b in "abcdefgh"}  # more than fifty within two edits
    fuzzy = ["washington", "commonpreaa", "abc", "ab", "a", "acbacb", "smiht", "abcabcabc", "washingotn"] + r.sample(sorted(words), 60)
    wild = ["*mit*", "*ten", "sm?th", "*", "??", "?", "a*", "*%*", "*_*", "*\\*", "a?b*", "*é?c*", "?*a", "zzz*", "*ab", "***", "abcabc"]
    patterns = [(p, "fuzzy") for p in fuzzy] + [(p, "wild") for p in wild]
    keys = ps.term_keys(spark.createDataFrame([("an", w) for w in words], "field string, term string")).cache()
    counts = keys.where("kind = 'gram'").groupBy("field", "key").agg(F.count(F.lit(1)).alias("n"))
    asked = spark.createDataFrame([(p, k, "an") for p, k in patterns], "pattern string, kind string, field string")
    got = {(x["pattern"], x["kind"], x["term"], round(x["weight"], 9)) for x in ps.matches(asked, keys, counts).collect()}
    want = brute(patterns, words)
    assert got - want == set() == want - got
    assert sum(p == "commonpreaa" for p, *_ in want) == 50 and any(w < 0.82 for p, k, _, w in want if p == "washington")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    r = random.Random(5)
    names = ["one", "two", "three", "free", "won", "o", "t", "threee", "seven", "one-two", "-", "washington", "wahsingtno"]
    rows = [(str(k), n, None, g, None) for k, n, g in [(k, " ".join(r.choices(names, k=r.randint(1, 3))) if k % 9 else "-", r.choice(["male", "female", None])) for k in range(600)]]
    df = spark.createDataFrame(PEOPLE + [(f"x{i}", *rest) for i, *rest in rows], "Id string, name__fname_an string, name__lname_an string, Gender__facet_text string, name__fname_an_mv array<string>")
    made = index(df, SYN).cache()
    return made, ps.write_postings(made, str(tmp_path_factory.mktemp("postings")), "Id", name_search.fields_of("name__fname", columns=made.columns))


TEXTS = ["one", "o t", "two one", "three", "o two", "o*", "*hre*", "*n two", "washingotn", "nobody", "seven one two", "t"]


@pytest.mark.parametrize(("k", "tie", "fuzzy"), [(10, 0.0, True), (3, 0.25, False)])
def test_first_k_equal_the_full_ranking(spark, stored, k, tie, fuzzy):
    df, posted = stored
    queries = [(t, NameQuery(t, is_surname=False, surname_field=False, gender_value="female", tie=tie, usefuzzy=fuzzy)) for t in TEXTS]
    excluded = df.where(F.col("Gender__facet_text") == "female").select(F.col("Id").alias("doc"))
    clauses = bulk_match.clause_table(spark, queries)
    ranking = {}
    for r in bulk_match.bulk_match(clauses, posted, tie, excluded).collect():
        ranking.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["doc"]))
    want = {q: [d for _, d in sorted(v)[:k]] for q, v in ranking.items()}
    got = {}
    for r in bulk_match.top_matches(clauses, posted, k, tie, excluded).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc"])
    assert got == want


def test_one_query_equals_the_scan_and_reads_its_terms_only(spark, stored):
    df, posted = stored
    for text in ("two one", "*hre*", "washingotn"):
        query = NameQuery(text, is_surname=False, surname_field=False, usefuzzy=True)
        got = {r["doc"]: round(r["score"], 9) for r in bulk_match.match_one(posted, query).collect()}
        assert got == {r["Id"]: round(r["score"], 9) for r in name_search.name_search(df, query, "name__fname").collect()}
    of = posted.of([("an", "seven"), ("rs", an.code("one"))])
    plan = of._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(EqualTo(field,an),EqualTo(term,seven))" in plan
    assert of.count() == posted.table("postings").where("(field = 'an' and term = 'seven') or (field = 'rs' and term = 'O080')").count() > 0


def test_a_lookup_reads_in_proportion_to_its_postings(spark, tmp_path):
    rows = spark.range(60_000).select("id", F.concat(F.lit("w"), F.lpad((F.col("id") % 3000).cast("string"), 4, "0")).alias("w"))
    posted = ps.write_postings(rows, str(tmp_path / "p"), "id", {"an": "w"})
    read = posted.of([("an", "w0007")])
    read.collect()
    plan = read._jdf.queryExecution().executedPlan()
    scans = [line for line in _metrics(plan)]
    assert read.count() == 20 and max(scans) < 60_000 / 4


def _metrics(plan):
    """Rows that the scans of an executed plan gave."""
    out, stack = [], [plan]
    while stack:
        node = stack.pop()
        if "Scan" in node.nodeName():
            out.append(node.metrics().apply("numOutputRows").value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    return out


def test_a_dictionary_alone_gives_terms_uses_and_matches(spark, tmp_path):
    """Keys are written by kind, without postings, and matches are held against the terms before rows move."""
    r = random.Random(8)
    words = ["".join(r.choice("abé%_") for _ in range(r.randint(1, 10))) for _ in range(400)] + ["washington", "wahsingtno", "new\nline"]
    posted = ps.write_dictionary(spark.createDataFrame([("t", w) for w in words], "field string, term string"), str(tmp_path / "d"))
    assert {x["term"]: x["total_freq"] for x in posted.table("terms").collect()} == {w: words.count(w) for w in words}
    patterns = [(p, "wild") for p in ("*ab", "ab*", "*ab*", "??b", "?", "**", "*", "a*b", "*%", "_*", "*new*", "*line", "a?*", "ab", "***é")] + [("washingotn", "fuzzy"), ("abab", "fuzzy")]
    got = [(x["pattern"], x["kind"], x["term"], round(x["weight"], 9)) for x in posted.matches(spark.createDataFrame([(*p, "t") for p in patterns], "pattern string, kind string, field string")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(patterns, set(words))


def test_keys_are_what_deletions_give(spark):
    terms = ["a", "ab", "abc", "aabbcc", "abcdefg", "abcdefgh", "abcdefghi", "abcdéfghij", "aaaaaaaaaaaa"]
    rows = spark.createDataFrame([("t", w) for w in terms], "field string, term string")
    got = {(x["kind"], x["term"], x["key"]) for x in ps.term_keys(rows).where("kind in ('one', 'two')").collect()}
    n = F.char_length("term")
    want = {(kind, x["term"], k) for kind, edits, some in (("one", 1, n <= ps.LONG + 1), ("two", 2, n >= ps.LONG - 1)) for x in rows.where(some).select("term", ps.deletions(F.col("term"), edits).alias("keys")).collect() for k in x["keys"]}
    assert got == want
