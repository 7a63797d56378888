"""One query for each operator of the name-search engine."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast import corpus
from onomast.functions import analysis as an
from onomast.functions import payload, surname
from onomast.functions import similarity as sim
from onomast.operators import bulk_match, hedge, name_search, sql_entry, tfidf, tree_search
from onomast.operators.ranks import running
from onomast.plans import query_tree as qt
from onomast.plans.name_query import NameQuery
from onomast.sources import store
from onomast.sources.schema import index, read_synonyms
from onomast.sources.segments import norm_columns

Query = Callable[[SparkSession, str], DataFrame]


def _scored(df: DataFrame) -> DataFrame:
    return df.select("p_partkey", F.round("score", 6).alias("score"))


def _first(text: str, **options) -> Query:
    query = NameQuery(text, **({"is_surname": False} | options), surname_field=False)
    return lambda spark, d: _scored(name_search.name_search(corpus.first_names(spark, d), query, "n__fname", gender="gender"))


def _last(text: str, **options) -> Query:
    query = NameQuery(text, **options, surname_field=True)
    return lambda spark, d: _scored(name_search.name_search(corpus.last_names(spark, d), query, "n__lname", gender="gender"))


def _term(term: str, target: int | None) -> Query:
    return lambda spark, d: _scored(name_search.term_query(corpus.first_names(spark, d), "n__fname_an", term, target))


def _multi(pattern: str, kind: str, target: int) -> Query:
    return lambda spark, d: _scored(name_search.multi_term_query(corpus.first_names(spark, d), "n__fname_an", pattern, kind, target))


def name_mv(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = NameQuery("ring", is_surname=True, surname_field=False)
    return _scored(name_search.name_search(corpus.many_names(spark, sf_dir), query, "n__fname", mv=True))


def name_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_search.ranked(_first("red widget")(spark, sf_dir), "p_partkey", 10)


def field_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(name_search.field_query(corpus.first_names(spark, sf_dir), "n__fname_an_initial", ["r", "w"]))


def payload_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = corpus.parts(spark, sf_dir).withColumn("t", an.first_an(F.col("name")))
    return _scored(payload.payload_query(df, "t", "widget", 2, 2))


def surname_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = corpus.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return surname.transform_surnames(names, {"name": {"surname_col": "key", "regex": "^([A-Za-z]+)", "default_match": "([5])"}}).select("c_custkey", "key")


def analysed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = corpus.last_names(spark, sf_dir)
    t = df.select("p_partkey", F.explode("n__lname_an").alias("t"))
    return t.select("p_partkey", F.col("t.token").alias("token"), F.col("t.pos").cast("bigint").alias("pos"))


def phonetic_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = corpus.read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select("word", an.phonetic_code(F.col("word")).alias("code"))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.read(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.sha2(an.fold(F.col("text")), 256).alias("folded"))


def tfidf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.document_words(spark, sf_dir)
    return tfidf.tfidf(docs, "words", ["the", "stupid"]).select("doc_id", F.round("score", 6).alias("score"))


def length_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.document_words(spark, sf_dir).select("doc_id", F.coalesce(F.size("words"), F.lit(0)).alias("n"))
    docs = docs.withColumn("n", F.greatest("n", F.lit(0)))
    return docs.select("doc_id", F.col("n").cast("bigint").alias("n_words"), sim.norm_of(F.col("n")).alias("norm"))


def explain_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.document_words(spark, sf_dir)
    found = tfidf.tfidf(docs, "words", ["stupid"], explained=True).select("doc_id", F.col("explanation")[0].alias("e"))
    r = lambda c, name: F.round(c, 6).alias(name)
    return found.select("doc_id", r("e.value", "value"), r("e.field_weight.tf", "tf"), r("e.field_weight.idf", "idf"), r("e.field_weight.field_norm", "field_norm"))


def phrase_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, freqs = tfidf.term_statistics(corpus.document_words(spark, sf_dir), "words", ["the", "stupid"])
    made = sim.phrase_idf(freqs, n)
    return spark.createDataFrame([(round(made["value"], 6), made["details"][0]["description"])], "idf double, first_detail string")


def overlap_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = corpus.last_names(spark, sf_dir)
    plain = dataclasses.replace(sim.CLASSIC, discount_overlaps=False)
    return df.select("p_partkey", sim.CLASSIC.length_norm(F.col("n__lname_an")).alias("discounted"), plain.length_norm(F.col("n__lname_an")).alias("whole"))


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct part name against the whole corpus, by the postings join."""
    clauses = bulk_match.clause_rows(corpus.read(spark, sf_dir, "part"), "p_name", {"is_surname": False, "surname_field": False})
    return _bulk(spark, sf_dir, clauses)


def bulk_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy and wildcard words by the postings join."""
    options = {"is_surname": False, "surname_field": False, "usephonetic": False, "useinitial": False, "usesyn": False, "usenull": False}
    queries_ = [("rign", NameQuery("rign", usefuzzy=True, **options)), ("widgte red", NameQuery("widgte red", usefuzzy=True, **options)), ("re* *et", NameQuery("re* *et", **options)), ("b?lt", NameQuery("b?lt", **options))]
    return _bulk(spark, sf_dir, bulk_match.clause_table(spark, queries_))


def _bulk(spark: SparkSession, sf_dir: str, clauses: DataFrame) -> DataFrame:
    found = bulk_match.bulk_match(clauses, corpus.name_postings(spark, sf_dir))
    return found.select("query_id", F.col("doc").alias("p_partkey"), F.round("score", 6).alias("score"))


def bulk_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best parts for every distinct part name."""
    clauses = bulk_match.clause_rows(corpus.read(spark, sf_dir, "part"), "p_name", {"is_surname": False, "surname_field": False})
    found = bulk_match.top_matches(clauses, corpus.name_postings(spark, sf_dir), 10)
    return found.select("query_id", F.col("doc").alias("p_partkey"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("place"))


def _tree(node: qt.Node, classic: bool = False) -> Query:
    """A combined query over first names, last names, gender and text; classic: the text by document frequencies and norms that the index keeps."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        index_ = corpus.people(spark, d)
        wanted = [t for c, t in qt.terms(node) if c == corpus.TEXT]
        docs, freqs = index_.frequencies(corpus.TEXT, wanted) if classic else (0, {})
        by_column = {corpus.TEXT: sim.CLASSIC} if classic else {}
        scoring = tree_search.Scoring(by_column, docs=docs, doc_freq=lambda column, term: freqs[term], norms=norm_columns([corpus.TEXT]))
        return _scored(tree_search.tree_search(index_.rows(), node, scoring))

    return run


FIRST_RED = qt.of_request("{!nameQuery f=n__fname isSurname=false}red")
LAST_WIDGET = qt.of_request('_query_:"{!nameQuery f=n__lname}widget"')
SOME_PLACES = qt.All(should=(qt.Positioned("n__lname_an", "widget", 1), qt.Payload("n__fname_an", "ring", 2, 2.0), qt.Words("n__fname_an_initial", ("r", "b"))), at_least=2)
NESTED = qt.All(must=(qt.All(should=(FIRST_RED, qt.Positioned("n__fname_an", "bl", 0, "prefix"))), qt.All(should=(qt.Words("n__lname_an", ("ring", "bolt", "red")), LAST_WIDGET), boost=2)), must_not=(qt.All(must=(qt.Value("gender", "female"), qt.Words("n__fname_an", ("ring",)))),))


def segments_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classic scores over an index with additions, replacements and deletions, by the frequencies and norms that it keeps."""
    index_ = corpus.changed_documents(spark, sf_dir)
    terms = ["the", "stupid"]
    found = tfidf.tfidf(index_.rows(), "body__text", terms, statistics=index_.frequencies("body__text", terms), norm="body__text_norm")
    return found.select("doc_id", F.round("score", 6).alias("score"))


def segments_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live rows of the same index in their order of insertion, which breaks ties."""
    live = corpus.changed_documents(spark, sf_dir).rows().select("doc_id", "_seq")
    return running(live, [F.col("_seq").asc()]).select("doc_id", F.col("n_before").alias("place"))


#: A word like many of the documents: more than fifty of sf0.01 are within two edits.
LONG_WORD = "thtiontion"


def fuzzy_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits of a long word, as a name query over the documents' long words: the best fifty of them."""
    query = NameQuery(LONG_WORD, is_surname=False, surname_field=False, usefuzzy=True, usephonetic=False, useinitial=False, usenull=False, usesyn=False)
    df, dictionary = corpus.long_words(spark, sf_dir)
    return _scored(name_search.name_search(df, query, "n__fname", dictionary=dictionary))


def target_fuzzy_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, dictionary = corpus.long_words(spark, sf_dir)
    return _scored(name_search.multi_term_query(df, "n__fname_an", LONG_WORD, "fuzzy", 1, dictionary))


def _posted(text: str, **options) -> Query:
    """A query by the stored postings of its own terms."""
    query = NameQuery(text, is_surname=False, surname_field=False, **options)
    return lambda spark, d: bulk_match.match_one(corpus.name_postings(spark, d), query).select(F.col("doc").alias("p_partkey"), F.round("score", 6).alias("score"))


def fuzzy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best fifty words of the documents for each word of the benchmark with an exchange of its last two letters: one edit, or two of long words."""
    words = corpus.read(spark, sf_dir, "benchmark").select(F.explode(an.words(F.col("text"))).alias("w")).where("w rlike '^[a-z]{4,}$'").distinct()
    n = F.char_length("w")
    changed = F.concat(F.substr("w", F.lit(1), n - 2), F.substr("w", n, F.lit(1)), F.substr("w", n - 1, F.lit(1)))
    found = corpus.word_postings(spark, sf_dir).matches(words.select(changed.alias("pattern"), F.lit("fuzzy").alias("kind"), F.lit("text").alias("field")))
    return found.select("pattern", "term", F.round("weight", 6).alias("weight"))


def wildcard_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words and documents each end, middle or pattern of the benchmark's words takes in; none begins with a letter."""
    words = corpus.read(spark, sf_dir, "benchmark").select(F.explode(an.words(F.col("text"))).alias("w")).where("w rlike '^[a-z]{5,}$'").distinct()
    tail = F.substr("w", F.char_length("w") - 3)
    made = F.array(F.concat(F.lit("*"), tail), F.concat(F.lit("*"), F.substring("w", 2, 3), F.lit("*")), F.concat(F.lit("?"), F.substring("w", 2, 20)))
    index = corpus.word_postings(spark, sf_dir)
    found = index.matches(words.select(F.explode(made).alias("pattern"), F.lit("wild").alias("kind"), F.lit("text").alias("field")))
    counted = found.join(index.table("terms"), ["field", "term"]).groupBy("pattern")
    return counted.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total_freq").alias("n_uses"))


def replica_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = corpus.read(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1).alias("change"))
    return hedge.replica_order(events, "event_type", "change")


def explain_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = NameQuery("red widget", is_surname=False, surname_field=False)
    found = name_search.explained(corpus.first_names(spark, sf_dir), query, "n__fname")
    e = found.select("p_partkey", F.explode("explanation").alias("e")).select("p_partkey", "e.*")
    return e.select("p_partkey", F.col("tok").cast("bigint").alias("tok"), "field", F.round("score", 6).alias("score"), "best")


def request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request with a multi-valued field, the usual gender field and an excluded gender."""
    return _scored(name_search.request(corpus.many_names(spark, sf_dir), {"v": " ring widget", "f": "n__fname_mv", "isSurname": "false", "gendervalue": "male", "usephonetic": "FALSE", "useinitial": "no", "synboost": "0.5"}))


def name_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first("  ")(spark, sf_dir)


def name_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _first("red widget")(spark, sf_dir)
    top, total = name_search.with_total(found, "p_partkey", 5)
    return spark.createDataFrame(top, found.schema).withColumn("total", F.lit(total).cast("bigint"))


def response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response of five rows and the number of all, written as JSON lines and read again."""
    path = f"{store.shared_folder(spark)}/onomast-response-{uuid.uuid4().hex}"
    name_search.response(_first("red ring")(spark, sf_dir), "p_partkey", 5, path)
    lines = spark.read.schema("numFound bigint, maxScore double, p_partkey bigint, score double").json(path)
    return lines.select("numFound", F.round("maxScore", 6).alias("maxScore"), "p_partkey", "score")


def _sql(text: str, surname: bool, options: str = "") -> Query:
    """A search by the SQL table function."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        name = "last" if surname else "first"
        (corpus.last_names if surname else corpus.first_names)(spark, d).createOrReplaceTempView(f"onomast_{name}")
        sql_entry.register(spark, f"onomast_{name}", "n__lname" if surname else "n__fname", surname, gender="gender", name=f"onomast_{name}_search")
        return spark.sql(f"SELECT p_partkey, round(score, 6) AS score FROM onomast_{name}_search('{text}'{options})")

    return run


def match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(name_search.match_all(corpus.first_names(spark, sf_dir)))


def missing_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's place by descending gender where half is missing: the missing ones are last."""
    df = corpus.parts(spark, sf_dir).withColumn("g", F.when(F.col("p_partkey") % 2 == 0, F.col("gender")))
    return running(df, [F.col("g").desc_nulls_last(), F.col("p_partkey").asc()]).select("p_partkey", "g", (F.col("n_before") + 1).alias("place"))


def synonym_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(name_search.term_query(corpus.first_names(spark, sf_dir), "n__fname_syn", an.query_synonym_words("Band!")[0], 1))


def synonym_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synonym file written, read and used."""
    path = f"{store.shared_folder(spark)}/onomast-synonyms-{uuid.uuid4().hex}"
    spark.createDataFrame([("Red => red, crimson",), ("# no rule",), ("ring=>ring,band",)], "value string").write.text(path)
    df = index(corpus.parts(spark, sf_dir).withColumnRenamed("name", "n__fname_an"), {"fname": read_synonyms(spark, path)})
    return _scored(name_search.term_query(df, "n__fname_syn", "crimson"))


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written, opened again and searched."""
    path = f"{store.shared_folder(spark)}/onomast-names-{uuid.uuid4().hex}"
    store.write_index(corpus.parts(spark, sf_dir).withColumnRenamed("name", "n__lname_an"), path, corpus.SYNONYMS)
    query = NameQuery("red widget", surname_field=True)
    return _scored(name_search.name_search(store.open_index(spark, path), query, "n__lname"))


def _tokens(df: DataFrame, key: str, tokens: str) -> DataFrame:
    t = df.select(key, F.explode(tokens).alias("t"))
    return t.select(key, F.col("t.token").alias("token"), F.col("t.pos").cast("bigint").alias("pos"))


def whitespace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(corpus.parts(spark, sf_dir).withColumn("t", an.whitespace_words(F.concat(F.lit(" "), F.upper("name"), F.lit(" x")))), "p_partkey", "t")


def analysed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index(corpus.read_spread(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body__text")))
    return df.select("doc_id", F.size("body__text").cast("bigint").alias("n"), F.sha2(F.array_join(F.transform("body__text", lambda t: t["token"]), " "), 256).alias("tokens"))


def field_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of dynamic field but the names: plain, several values, place, facet, generic text of several values, date."""
    p = corpus.read_spread(spark, sf_dir, "part")
    text = lambda c: F.col(c).cast("string")
    df = p.select(
        "p_partkey", text("p_size").alias("a__int"), text("p_retailprice").alias("b__double"), F.array(text("p_size"), F.lit("7")).alias("c__int_mv"), F.lit("true").alias("d__boolean"),
        F.concat(text("p_size"), F.lit(" , -1.5")).alias("e__location"), F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("f__facet_text"), F.array(F.upper("p_name"), F.lit(" Q ")).alias("g__facet_text_mv_ordered"),
        F.array("p_name", F.lit("Last one")).alias("h__text_mv"), F.lit("2001-02-03 04:05:06").alias("i__date"), F.col("p_name").alias("j__fname_an_initial"), F.concat(F.lit("\u00c9"), "p_name").alias("k__lname"),
    )
    x = index(df)
    return x.select(
        "p_partkey", F.col("a__int").cast("bigint").alias("a"), F.round("b__double", 2).alias("b"), F.aggregate("c__int_mv", F.lit(0), lambda s, v: s + v).cast("bigint").alias("c"), F.col("d__boolean").alias("d"), (F.col("e__location.lat") + F.col("e__location.lon")).alias("e"),
        F.col("f__facet_text").alias("f"), F.array_join("g__facet_text_mv_ordered", "|").alias("g"), F.array_max(F.transform("h__text_mv", lambda t: t["pos"])).cast("bigint").alias("h"), F.year("i__date").cast("bigint").alias("i"), F.array_join(F.transform("j__fname_an_initial", lambda t: t["token"]), "").alias("j"), F.col("k__lname").alias("k"),
    )


def payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = corpus.read(spark, sf_dir, "part").select("p_partkey", payload.encode_int(F.col("p_partkey") * 1000).alias("b"))
    return made.select("p_partkey", F.hex("b").alias("bytes"), payload.decode_int(F.col("b")).cast("bigint").alias("n"))


def payload_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What payloads count under either similarity, and the document's score where none was seen."""
    df = corpus.parts(spark, sf_dir).withColumn("t", an.first_an(F.col("name")))
    of = lambda s: payload.payload_sum(F.col("t"), "widget", s)
    return df.select("p_partkey", of(sim.CLASSIC).alias("classic"), of(sim.FLAT).alias("flat"), payload.doc_score(payload.payload_score(F.col("t"), "widget", 2, 2)).alias("doc_score"))


def queries() -> dict[str, Query]:
    return {
        "term_any": _term("red", None), "target_pos_0": _term("widget", 0), "target_pos_1": _term("widget", 1), "target_pos_10": _term("widget", 10),
        "target_prefix": _multi("wi", "prefix", 1), "target_wildcard": _multi("r*d", "wildcard", 1), "target_fuzzy": _multi("rign", "fuzzy", 0),
        "name_basic": _first("red widget"), "name_tie": _first("red widget", tie=0.1), "name_exact": _first("Red Widget", useexact=True),
        "name_synonym": _first("crimson widget", usephonetic=False), "name_initial": _first("r widget"), "name_null": _first("nothing", useinitial=False),
        "name_phonetic": _first("redd wydget", useinitial=False), "name_wildcard": _first("re* wid?et"), "initial_wildcard": _first("r*"), "initial_wildcard_positioned": _first("r*", compat=False),
        "name_fuzzy": _first("widgte", usefuzzy=True, usephonetic=False), "name_gender": _first("red widget", gender_value="male"),
        "name_surname_concat": _last("red widget"), "name_surname_single": _last("redwidget", gender_value="female"), "name_mv": name_mv, "name_top10": name_top10,
        "field_query": field_query, "payload_position": payload_position, "surname_key": surname_key, "analysed_tokens": analysed_tokens, "phonetic_codes": phonetic_codes,
        "ascii_folding": folded, "tfidf_documents": tfidf_documents, "length_norm": length_norm, "explain_terms": explain_terms, "bulk_match": bulk, "replica_order": replica_order,
        "tree_names": _tree(qt.All(must=(FIRST_RED, LAST_WIDGET), must_not=(qt.Value("gender", "male"),))), "tree_places": _tree(SOME_PLACES), "tree_nested": _tree(NESTED),
        "tree_mixed": _tree(qt.All(must=(FIRST_RED,), should=(qt.Words(corpus.TEXT, ("promo", "ring", "brand")),)), classic=True), "segments_tfidf": segments_tfidf, "segments_order": segments_order,
        "bulk_open": bulk_open, "bulk_top10": bulk_top10, "posted_basic": _posted("red widget"), "posted_fuzzy": _posted("widgte", usefuzzy=True, usephonetic=False), "fuzzy_words": fuzzy_words, "wildcard_words": wildcard_words, "explain_name": explain_name, "request": request, "name_empty": name_empty, "name_total": name_total, "response_lines": response_lines, "sql_first": _sql("red widget", False, ", is_surname => false"), "sql_last": _sql("red widget", True), "match_all": match_all, "missing_last": missing_last,
        "synonym_position": synonym_position, "synonym_file": synonym_file, "stored_index": stored_index, "whitespace_tokens": whitespace_tokens, "analysed_text": analysed_text,
        "field_types": field_types, "payload_bytes": payload_bytes, "payload_scores": payload_scores, "phrase_idf": phrase_idf, "overlap_norm": overlap_norm,
        "name_fuzzy_two": fuzzy_two, "target_fuzzy_two": target_fuzzy_two, "surname_wildcard": _last("wi*t"),
    }
