r"""Benchmark decontamination by a distributed positional inverted index (operator 9, DataFrame functions only).

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. An item's windows are its runs of ``n`` words, or the whole
item if it has fewer. Steps:

1. The index: postings (document, position, term) of all documents, stored once. No term can be asked for but those of the
   test set, so the scan that builds it keeps these alone, as numbers; ``build_index`` without terms stores every term.
2. Term counts from the index put each window's terms in order. The lists of its two rarest, each less its offset in the
   item, are intersected: what is left are places (document, item, offset) where both stand as in the item.
3. At each place the lists of the window's other terms are intersected too; runs of ``n`` positions that are left are exact
   phrase matches. No text is read again.
4. Proximity, from the same index: items of which the three rarest terms (by count, then by letters) all stand within ``n``
   words of a document, in any order.

Plan: one tokenizing scan feeds the index through a join with the terms; every small side is broadcast only after its rows
and bytes were checked. First lists are joined with distinct (term, term, gap), not with items, so a term that many items share
is met once for each; lists are joined on (document, position, term), so a hot term or a passage that many documents share
is spread over documents and positions. Of the index, only documents with places take part in step 3. Rows of the index
are told apart by (identifier, hash of the text and of whether the identifier is null); repeated rows get equal results.

Defined results: null or wordless text has no words and no hits (items_sha256 is that of the empty string); a text or item of
any length is taken whole; an item without words has no windows; a null item_id is written as the empty string; repeated
item_ids count once; terms of equal count are taken in the order of their place; empty tables give empty or all-clean
results; further columns of any name are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, dropped, hinted

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows up to which a table is broadcast, if its bytes allow (``shared.BROADCAST_BYTES``).
BROADCAST_ROWS = 1_000_000
#: Rarest terms of an item that must stand near each other.
NEAR_TERMS = 3


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(lower, SEPARATORS, -1), ""), F.array().cast("array<string>"))


def items_of(benchmark: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (own number), item_id (string), words, m (number of words), w (words in a window); items without words are left out."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words(F.col(text_col)).alias("words"))
    rows = rows.withColumn("m", F.size("words")).where("m > 0").withColumn("w", F.least("m", F.lit(n)))
    return cut(rows.withColumn("item", F.monotonically_increasing_id()), "items")


def terms_of(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The test set's distinct terms (term, tid), and its lines (item, at, tid): which term stands where."""
    flat = items.select("item", F.posexplode("words").alias("at", "term"))
    terms = cut(flat.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")
    return terms, cut(flat.join(hinted(terms, BROADCAST_ROWS), "term").select("item", "at", "tid"), "lines")


def document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """What tells documents apart, without nulls: d and h."""
    own = F.col(id_col)
    return [F.coalesce(own, F.lit(0).cast(docs.schema[id_col].dataType)).alias("d"), F.xxhash64(F.col(text_col), own.isNull()).alias("h")]


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings (d, h, pos, term) of all documents; with ``terms`` (term, tid), of those alone, by number."""
    split = docs.select(*document(docs, id_col, text_col), words(F.col(text_col)).alias("words"))  # first, lest tokens carry their text
    tokens = split.select("d", "h", F.posexplode("words").alias("pos", "term"))
    if terms is not None:
        tokens = tokens.join(hinted(terms, BROADCAST_ROWS), "term").select("d", "h", "pos", F.col("tid").alias("term"))
    return cut(tokens.select("d", "h", "pos", "term"), "postings")


def rarest_pairs(items: DataFrame, lines: DataFrame, counts: DataFrame) -> DataFrame:
    """Of each window (item, begin) of which all terms are in the index: its two rarest terms a and b (null in windows of one
    word), a's offset ``at`` in the item, and b's distance ``gap`` from it."""
    known = lines.join(hinted(counts, BROADCAST_ROWS), lines.tid == counts.term, "left").select("item", "at", "tid", F.coalesce("n", F.lit(0)).alias("n"))
    sized = known.join(hinted(items.select("item", "m", "w"), BROADCAST_ROWS), "item")
    begins = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("w") + 1), F.least("at", F.col("m") - F.col("w"))))
    windows = sized.select("item", begins.alias("begin"), F.struct("n", "at", "tid").alias("x"))  # a word is in at most n windows
    best = windows.groupBy("item", "begin").agg(F.slice(F.sort_array(F.collect_list("x")), 1, 2).alias("t")).where(F.col("t")[0]["n"] > 0)
    second = F.get("t", F.lit(1))
    return cut(best.select("item", "begin", F.col("t")[0]["tid"].alias("a"), F.col("t")[0]["at"].alias("at"), second["tid"].alias("b"), (second["at"] - F.col("t")[0]["at"]).alias("gap")), "pairs")


def places(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct (d, h, item, delta, begin): the window's two rarest terms stand as if the item's word 0 were at position delta."""
    keys = cut(pairs.select("a", "b", "gap").distinct(), "keys")
    first = postings.join(hinted(keys, BROADCAST_ROWS), F.col("term") == F.col("a")).select("d", "h", "pos", "a", "b", "gap")
    wanted = cut(keys.select(F.col("b").alias("term")).where("term is not null").distinct(), "seconds")
    second = postings.join(hinted(wanted, BROADCAST_ROWS), "term", "left_semi").select("d", "h", (F.col("pos")).alias("at_b"), F.col("term").alias("b"))
    met = first.where("b is not null").withColumn("at_b", F.col("pos") + F.col("gap")).join(second, ["d", "h", "at_b", "b"], "left_semi")
    both = met.select("d", "h", "pos", "a", "b", "gap").unionByName(first.where("b is null").select("d", "h", "pos", "a", "b", "gap"))
    same = (F.col("p.a") == F.col("q.a")) & F.col("p.b").eqNullSafe(F.col("q.b")) & F.col("p.gap").eqNullSafe(F.col("q.gap"))
    found = both.alias("p").join(hinted(pairs, BROADCAST_ROWS).alias("q"), same)
    return found.select("p.d", "p.h", "q.item", (F.col("p.pos") - F.col("q.at")).alias("delta"), "q.begin").distinct()


def matches(postings: DataFrame, items: DataFrame, lines: DataFrame, counts: DataFrame) -> DataFrame:
    """Exact phrase matches: d, h, item, w, begins (positions in the document at which a window begins), from the index alone."""
    at = cut(places(postings, rarest_pairs(items, lines, counts)), "places")
    sized = at.join(hinted(items.select("item", "w"), BROADCAST_ROWS), "item").select("d", "h", "item", "delta", F.explode(F.sequence("begin", F.col("begin") + F.col("w") - 1)).alias("at")).distinct()
    asked = sized.where("delta + at >= 0").join(hinted(lines, BROADCAST_ROWS), ["item", "at"]).select("d", "h", "item", "delta", "at", (F.col("delta") + F.col("at")).alias("pos"), F.col("tid").alias("term"))
    held = postings.join(hinted(cut(at.select("d", "h").distinct(), "held"), BROADCAST_ROWS), ["d", "h"], "left_semi")
    there = asked.join(held, ["d", "h", "pos", "term"], "left_semi").groupBy("d", "h", "item", "delta").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    there = there.join(hinted(items.select("item", "w"), BROADCAST_ROWS), "item")
    run = F.filter("ats", lambda x, i: F.get(F.col("ats"), i + F.col("w") - 1) == x + F.col("w") - 1)
    return there.withColumn("starts", run).where(F.size("starts") > 0).select("d", "h", "item", "w", F.transform("starts", lambda x: x + F.col("delta")).alias("begins"))


def proximity(postings: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """d, h, item, begin, end of stretches of at most ``span`` words that hold all of an item's wanted terms (item, term, slot:
    numbered from 0, at most ``NEAR_TERMS``), in any order; each begins at a posting of one of them."""
    marks = postings.join(hinted(wanted, BROADCAST_ROWS), "term").select("d", "h", "item", "pos", "slot").distinct()
    ahead = Window.partitionBy("d", "h", "item").orderBy("pos").rangeBetween(0, span - 1)
    nexts = [F.min(F.when(F.col("slot") == i, F.col("pos"))).over(ahead).alias(f"next{i}") for i in range(NEAR_TERMS)]
    most = wanted.groupBy("item").agg((F.max("slot") + 1).alias("k"))
    rows = marks.select("d", "h", "item", F.col("pos").alias("begin"), *nexts).join(hinted(cut(most, "most"), BROADCAST_ROWS), "item")
    there = sum((F.col(f"next{i}").isNotNull().cast("int") for i in range(NEAR_TERMS)), F.lit(0))
    return rows.where(there == F.col("k")).select("d", "h", "item", "begin", F.greatest(*(F.col(f"next{i}") for i in range(NEAR_TERMS))).alias("end"))


def rarest_terms(lines: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, term, slot): the ``NEAR_TERMS`` rarest distinct terms of each item; none of an item of which one is nowhere."""
    own = lines.select("item", "tid").distinct().join(hinted(terms, BROADCAST_ROWS), "tid")
    known = own.join(hinted(counts.withColumnRenamed("term", "tid"), BROADCAST_ROWS), "tid", "left").select("item", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "tid").alias("x"))
    best = known.groupBy("item").agg(F.slice(F.sort_array(F.collect_list("x")), 1, NEAR_TERMS).alias("best")).where(F.col("best")[0]["n"] > 0)
    return best.select("item", F.posexplode("best").alias("slot", "x")).select("item", F.col("x.tid").alias("term"), "slot")


def judge(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """A row per document: doc_id, d, h (see :func:`document`), n_words, n_hit, n_items, items_sha256, contaminated (hit words
    are a twentieth or more), n_near_items (items by proximity)."""
    items = items_of(benchmark, n)
    terms, lines = terms_of(items)
    postings = build_index(docs, terms)
    counts = cut(postings.groupBy("term").agg(F.count("*").alias("n")), "counts")
    hits = cut(matches(postings, items, lines, counts), "hits")
    names = hinted(items.select("item", "item_id"), BROADCAST_ROWS)
    spread = F.explode(F.flatten(F.transform("begins", lambda b: F.sequence(b, b + F.col("w") - 1))))
    n_hit = hits.select("d", "h", spread.alias("pos")).distinct().groupBy("d", "h").agg(F.count("*").alias("n_hit"))
    ids = hits.select("d", "h", "item").join(names, "item").groupBy("d", "h").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    near = proximity(postings, cut(rarest_terms(lines, terms, counts), "rarest"), n).select("d", "h", "item").distinct()
    near = near.join(names, "item").groupBy("d", "h").agg(F.count_distinct("item_id").alias("n_near_items"))
    found = cut(n_hit.join(ids, ["d", "h"]).join(near, ["d", "h"], "full"), "found")
    dropped(postings)
    rows = docs.select("doc_id", *document(docs), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    all_ = rows.join(hinted(found, BROADCAST_ROWS), ["d", "h"], "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    return all_.select("doc_id", "d", "h", "n_words", n_hit.cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """:func:`judge` without what tells documents apart."""
    return judge(docs, benchmark, n).drop("d", "h")


#: DuckDB: every document window of every window length against every item window; nearness from every word of every document.
SQL = r"""
with item as (
  select item_id, row_number() over () as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), iw as (
  select distinct item_id, w, array_to_string(ws[b : b + w - 1], ' ') as g
  from (select *, unnest(range(1, len(ws) - w + 2)) as b from (select *, least(len(ws), 13) as w from item where len(ws) > 0))
), doc as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from documents
), dw as (
  select doc_id, w, b, array_to_string(ws[b : b + w - 1], ' ') as g
  from (select doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) as b from doc, (select distinct w from iw) where len(ws) >= w)
), hit as (
  select distinct dw.doc_id, dw.w, dw.b, iw.item_id from dw join iw on dw.w = iw.w and dw.g = iw.g
), hw as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(b, b + w)) as p from hit) group by doc_id
), hi as (
  select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, item_id::varchar as i from hit) group by doc_id
), dt as (
  select doc_id, unnest(ws) as t, unnest(range(0, len(ws))) as p from doc
), rk as (
  select r, item_id, t, coalesce(n, 0) as n, row_number() over (partition by r order by coalesce(n, 0), t) as slot
  from (select r, item_id, unnest(list_distinct(ws)) as t from item) left join (select t, count(*) as n from dt group by t) using (t) qualify slot <= 3
), mk as (
  select doc_id, r, item_id, slot, p, k from dt join rk using (t) join (select r, count(*) as k from rk group by r having min(n) > 0) using (r)
), nr as (
  select doc_id, count(distinct item_id) as n_near from (
    select a.doc_id, a.item_id from mk a join mk b on a.doc_id = b.doc_id and a.r = b.r and b.p between a.p and a.p + 12 group by a.doc_id, a.r, a.item_id, a.p, a.k having count(distinct b.slot) = a.k
  ) group by doc_id
)
select doc.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated,
  coalesce(n_near, 0)::bigint as n_near_items
from doc left join hw using (doc_id) left join hi using (doc_id) left join nr using (doc_id)
"""
