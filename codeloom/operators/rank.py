"""Lexical ranking: BM25 over path, content and symbols, a path boost, and a plain scan.

The corpus statistics (documents, lengths, matches of each term) are one
aggregation; ranks are a projection and a top-k, so no text is shuffled. A stored
index has postings, and `rank_index` answers a query from the rows of its terms.
"""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_test_path, query_terms
from ..shared import materialize

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
CANDIDATES = 80
PATH_BOOST = 4.0
COLUMNS = ("path", "content", "symbols")


def _unaccented() -> tuple[str, str]:
    """Letters with combining marks, and what stays of them; then the marks alone,
    of which nothing stays."""
    marks = [chr(c) for c in range(0x300, 0x370)]
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if x not in marks)
        if bare != c and len(bare) == 1:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


def plain(text: Column) -> Column:
    """Lower case without accents; only text beyond ASCII is translated."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.octet_length(low) > F.length(low), F.translate(low, *_unaccented())).otherwise(low)


def tokens(text: Column) -> Column:
    return F.filter(F.split(plain(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _fold(term: str) -> list[str]:
    flat = "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c)).lower()
    return [t for t in re.split(r"[\W_]+", flat) if t]


def _hits(column: str, phrase: list[str]) -> Column:
    """How often a phrase of adjacent tokens occurs in a token array."""
    if len(phrase) == 1:
        return F.size(F.filter(column, lambda t: t == phrase[0]))
    want = F.array(*map(F.lit, phrase))
    n = F.size(column) - (len(phrase) - 1)
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(column, i, len(phrase)) == want))).otherwise(0)


def _score(idfs: list[float], average: float, hits: str = "hits", length: str = "len") -> Column:
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col(length) / F.lit(average))
    total = F.lit(0.0)
    for i, idf in enumerate(idfs):
        tf = F.get(hits, F.lit(i)).cast("double")
        total = total + F.lit(idf) * tf * F.lit(K1 + 1) / (tf + norm)
    return total


def idf_of(n_docs: int, n_with: int) -> float:
    value = math.log((n_docs - n_with + 0.5) / (n_with + 0.5))
    return value if value > 0 else LEAST_IDF


def bm25(files: DataFrame, query: str) -> DataFrame:
    """(path, score) of every file with a term of the query, unranked.

    `files` has path, content and symbols. Repeated terms count each time.
    """
    terms = [p for p in map(_fold, query_terms(query)) if p]
    if not terms:
        return files.select("path", F.lit(0.0).alias("score")).limit(0)
    held = files.select("path", *(tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(COLUMNS)))
    # counts are a few numbers a file: written once, read for the statistics and for the scores
    counted = held.select("path", sum(F.size(f"t{i}") for i in range(3)).alias("len"), F.array(*(sum(_hits(f"t{i}", p) for i in range(3)) for p in terms)).alias("hits"))
    counted = materialize(counted, "term-counts")
    stats = counted.agg(F.count("*").alias("n"), F.sum("len").alias("len"), *(F.count_if(F.get("hits", F.lit(i)) > 0).alias(f"d{i}") for i in range(len(terms)))).first()
    if not stats.n or not stats.len:
        return files.select("path", F.lit(0.0).alias("score")).limit(0)
    idfs = [idf_of(stats.n, stats[f"d{i}"]) for i in range(len(terms))]
    return counted.where(F.exists("hits", lambda h: h > 0)).select("path", _score(idfs, stats.len / stats.n).alias("score"))


def _boosted(best: DataFrame, query: str, include_tests: bool) -> DataFrame:
    """The best by BM25 without test paths, then boosted by path."""
    if not include_tests:
        best = best.where(~is_test_path(F.col("path")))
    boost = F.lit(0.0)
    for term in query_terms(query):
        boost = boost + F.when(F.lower("path").contains(term), PATH_BOOST).otherwise(0.0)
    return best.select("path", (F.col("score") + boost).alias("score")).orderBy(F.desc("score"), "path")


def rank_files(files: DataFrame, query: str, include_tests: bool = True, limit: int = CANDIDATES) -> DataFrame:
    """(path, score): the best `limit` by BM25, test paths dropped after that, then boosted by path."""
    return _boosted(bm25(files, query).orderBy(F.desc("score"), "path").limit(limit), query, include_tests)


def rank_index(terms: DataFrame, lengths: DataFrame, files: DataFrame, query: str, include_tests: bool = True, limit: int = CANDIDATES) -> DataFrame:
    """The same as `rank_files` over `files`, from the index's postings: only the
    rows of the query's terms are read, and texts only where a term is a phrase,
    of files that hold all its tokens."""
    return _boosted(rank_postings(terms, lengths, query, limit, files), query, include_tests)


def postings(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverted index: (term, path, tf) and (path, len)."""
    held = files.select("path", F.flatten(F.array(*(tokens(F.col(c)) for c in COLUMNS))).alias("t"))
    return held.select("path", F.explode("t").alias("term")).groupBy("term", "path").agg(F.count("*").alias("tf")), held.select("path", F.size("t").alias("len"))


def _phrase_rows(terms_table: DataFrame, files: DataFrame, phrases: list[tuple[str, ...]]) -> DataFrame:
    """(path, term, tf) of phrases, counted in the files that hold all their tokens."""
    own = terms_table.where(F.col("term").isin(*{t for p in phrases for t in p})).groupBy("path").agg(F.collect_set("term").alias("held"))
    whole = F.lit(False)
    for p in phrases:
        whole = whole | (F.size(F.array_intersect("held", F.array(*map(F.lit, set(p))))) == len(set(p)))
    held = files.join(own.where(whole).select("path"), "path", "left_semi").select("path", *(tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(COLUMNS)))
    found = F.array(*(F.struct(F.lit(" ".join(p)).alias("term"), sum(_hits(f"t{i}", list(p)) for i in range(len(COLUMNS))).cast("long").alias("tf")) for p in phrases))
    return held.select("path", F.explode(found).alias("x")).select("path", "x.term", "x.tf").where("tf > 0")


def rank_postings(terms_table: DataFrame, lengths: DataFrame, query: str, limit: int = CANDIDATES, files: DataFrame | None = None) -> DataFrame:
    """(path, score): the best `limit` by BM25 from postings. Terms of several
    tokens are phrases, which need `files`."""
    wanted = [tuple(p) for p in map(_fold, query_terms(query)) if p]
    single, phrases = {p[0] for p in wanted if len(p) == 1}, sorted({p for p in wanted if len(p) > 1})
    n, total = lengths.agg(F.count("*"), F.sum("len")).first()
    if not wanted or not n or not total:
        return lengths.select("path", F.lit(0.0).alias("score")).limit(0)
    rows = terms_table.where(F.col("term").isin(*single)).select("path", "term", "tf")
    if phrases:
        if files is None:
            raise ValueError("phrases are counted in files")
        rows = materialize(rows.unionByName(_phrase_rows(terms_table, files, phrases)), "phrase-counts")
    with_term = {r.term: r.n for r in rows.groupBy("term").agg(F.count("*").alias("n")).collect()}
    said = [" ".join(p) for p in wanted]
    weight = F.create_map(*(F.lit(x) for t in set(said) for x in (t, idf_of(n, with_term.get(t, 0)) * said.count(t))))
    tf, norm = F.col("tf").cast("double"), F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.lit(total / n))
    scored = rows.join(lengths, "path").select("path", (F.element_at(weight, F.col("term")) * tf * F.lit(K1 + 1) / (tf + norm)).alias("s"))
    return scored.groupBy("path").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "path").limit(limit)


def scan_rank(files: DataFrame, symbols: DataFrame, imports: DataFrame, query: str, include_tests: bool = True) -> DataFrame:
    """(path, score > 0) by plain occurrence counts, where no full-text rank is to be had."""
    if not include_tests:
        files = files.where(~is_test_path(F.col("path")))
    names = symbols.groupBy(F.col("file_path").alias("path")).agg(F.array_join(F.collect_list(F.concat_ws(" ", "kind", "name", "signature")), "\n").alias("symbols"), F.lower(F.array_join(F.collect_list("name"), "\n")).alias("names"))
    targets = imports.groupBy(F.col("file_path").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("target")), "\n").alias("imports"))
    held = files.select("path", "content").join(names, "path", "left").join(targets, "path", "left")
    hay = F.lower(F.concat_ws("\n", "path", "content", F.coalesce("symbols", F.lit("")), F.coalesce("imports", F.lit(""))))
    symbol_text = F.lower(F.coalesce("symbols", F.lit("")))
    score = F.lit(0.0)
    for t in query_terms(query):
        score = score + (F.length(hay) - F.length(F.replace(hay, F.lit(t), F.lit("")))) / len(t) + F.when(F.lower("path").contains(t), 4.0).otherwise(0.0) + F.when(symbol_text.contains(t), 6.0).otherwise(0.0)
    return held.select("path", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "path")
