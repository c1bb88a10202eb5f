"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become words without punctuation; numbers, names (capitalised words that don't start a sentence) and units turn
into typed placeholders and the rest into lower case. Windows of WINDOW canonical words of documents and benchmark items are
joined by hash, and so are windows of their plain words in lower case: names can't be told in a text all in capitals or all in
lower case, so an item copied in such letters matches by its plain words. A canonical window must fill its slots consistently: within
it each slot value of the item stands for one value of the document, and the other way round. So a question with other numbers or names is found, and
a chance likeness with clashing values isn't; one clash costs the windows around it, not the rest of the item, and windows whose words are equal always count. A document is contaminated by an item if consistent windows match at
least ENOUGH places, or half of those that the item has; a place counts once, whichever kind matches.

Windows are taken of candidates only: documents in which a gram of GRAM words, looked at in every STRIDE-th place, is an item's. Each window
that an item shares holds such a place, so none is lost. Only hashes of grams and windows are joined: the benchmark's are broadcast if there are at most BROADCAST_WINDOWS of them, and both
sides are shuffled otherwise; texts never move, except those with matches.

Edge cases: null and empty texts match nothing, nor do items of fewer than WINDOW words; windows with fewer than LITERAL words
that aren't placeholders match by plain words only; repeated rows of a document or an item count once, and rows that repeat an id with another text are
each held against the items on their own (the id has what any of them has); extra columns don't take part; ties don't
arise, as all items that match are given.

n_windows and n_slots are of canonical windows; windows of either kind bring a pair over the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, table

WINDOW, LITERAL, ENOUGH = 8, 4, 6
#: A window holds a whole gram at one of any STRIDE places in turn.
GRAM = 5
STRIDE = WINDOW - GRAM + 1
BROADCAST_WINDOWS = 500_000
BROADCAST_DOCS = 2_000_000
#: Units of measure that are placeholders (fixed values).
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year dollars dollar euros euro cents cent percent degrees degree meters meter metres metre kilometers kilometer miles mile feet foot inches inch grams gram kilograms kilogram pounds pound liters liter litres litre".split()
START, POINT = "\ue000", "\ue001"
SENTENCE = r"(^\s*|[.!?][\"')\]]*\s+|\n\s*)(\p{Lu})"
JOINED = r"[.,:/](\p{N})"
OUTSIDE = r"[^\p{L}\p{N}" + START + POINT + r"]+"
NUMBER = " " + POINT + r"?\p{N}[^ ]*"
NAME = r" \p{Lu}[^ ]*"


def trie(words: list[str]) -> str:
    """A pattern for exactly these words that reads each letter once."""
    first = {}
    for w in words:
        if w:
            first.setdefault(w[0], []).append(w[1:])
    parts = [c + trie(rest) for c, rest in sorted(first.items())]
    body = parts[0] if len(parts) == 1 and "" not in words else "(?:" + "|".join(parts) + ")" if parts else ""
    return body + "?" if body and "" in words else body


UNIT = " " + trie(UNITS) + " "


def marked(text: Column) -> Column:
    """Words between single spaces; starts of sentences and inner points are marked."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(t.contains(START) | t.contains(POINT), F.translate(t, START + POINT, "  ")).otherwise(t)
    t = F.regexp_replace(t, SENTENCE, "$1" + START + "$2")
    t = F.regexp_replace(t, JOINED, POINT + "$1")
    return F.trim(F.regexp_replace(t, OUTSIDE, " "))


def canonical(words: Column) -> Column:
    """The array of canonical words of marked text; as many as it has words."""
    c = F.regexp_replace(F.concat(F.lit(" "), words), NUMBER, " #")
    c = F.lower(F.regexp_replace(c, NAME, " @"))
    c = F.concat(F.replace(c, F.lit(" "), F.lit("  ")), F.lit(" "))
    c = F.replace(F.regexp_replace(c, UNIT, " % "), F.lit(START), F.lit(""))
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(c), " +"))


def plain(words: Column) -> Column:
    """The array of the words of marked text in lower case, place by place those of canonical()."""
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(F.replace(words, F.lit(START), F.lit(""))), " "))


def once(c: Column) -> Column:
    """A column that the optimiser doesn't copy into each place that uses it: it is generated, as the one row of an array."""
    return F.explode(F.array(c))


def words_of(rows: DataFrame, key: str) -> DataFrame:
    """key, marked words m, canonical words c."""
    return rows.select(key, once(marked(F.col("text"))).alias("m")).select(key, "m", once(canonical(F.col("m"))).alias("c"))


def each_window(f):
    """f of the place (from 1) of each window's first word, in order; none if there are too few words."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(WINDOW - 1)))
    return F.when(F.size("w") >= WINDOW, F.transform(at, f))


def grams(rows: DataFrame, key: str, step: int) -> DataFrame:
    """key, hash and literal words (plain words are all literal) of the grams of canonical and of plain words in every step-th place."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("c") - F.lit(GRAM - 1)), F.lit(step))
    literal = lambda i: F.size(F.filter(F.slice("c", i, GRAM), lambda w: ~w.isin("#", "@", "%")))
    gram = lambda words, i, n: F.struct(F.xxhash64(F.slice(words, i, GRAM)).alias("h"), n.alias("literal")) if step == 1 else F.xxhash64(F.slice(words, i, GRAM))
    words = words_of(rows, key).select(key, "c", once(plain(F.col("m"))).alias("v")).filter(F.size("c") >= WINDOW)
    both = words.select(key, F.explode(F.concat(F.transform(at, lambda i: gram("c", i, literal(i))), F.transform(at, lambda i: gram("v", i, F.lit(GRAM))))).alias("h"))
    return both.select(key, "h.h", "h.literal") if step == 1 else both


def candidates(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id of every document that can share a window with an item, once."""
    # a window with enough literal words has some in each of its grams
    keys, _ = scratch.keep(grams(items, "item_id", 1).filter(F.col("literal") >= LITERAL - (WINDOW - GRAM)).select("h").distinct())
    small = keys.count() <= BROADCAST_WINDOWS
    found, _ = scratch.keep(grams(docs, "doc_id", STRIDE).join(F.broadcast(keys) if small else keys, "h", "left_semi").select("doc_id").distinct())
    return F.broadcast(found) if found.count() <= BROADCAST_DOCS else found


def hashed(rows: DataFrame, key: str) -> DataFrame:
    """key, c, and the hash of each canonical word as w, of each plain word as v: a window's hash is that of its words' hashes, each of which is taken once."""
    w = words_of(rows, key).select(key, "m", "c", once(F.transform("c", lambda x: F.xxhash64(x))).alias("w"))
    return w.select(key, "c", "w", once(F.transform(plain(F.col("m")), lambda x: F.xxhash64(x))).alias("v"))


def window(words: str, i: Column) -> Column:
    """Hash of the window whose first word is at i."""
    return F.xxhash64(F.slice(words, i, WINDOW))


def windows(rows: DataFrame, key: str) -> DataFrame:
    """key, position (from 0) and hash of each window of canonical words (canonical) and of each of plain words; without placeholders they have one hash."""
    both = F.concat(each_window(lambda i: window("w", i)), each_window(lambda i: window("v", i)))
    each = hashed(rows, key).select(key, (F.size("w") - F.lit(WINDOW - 1)).alias("n"), F.posexplode(both).alias("at", "h"))
    return each.select(key, F.pmod("at", "n").alias("pos"), (F.col("at") < F.col("n")).alias("canonical"), "h")


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, position, hashes of canonical and plain words, and literal words of each window of an item."""
    literal = lambda i: F.size(F.filter(F.slice("c", i, WINDOW), lambda w: ~w.isin("#", "@", "%")))
    at = each_window(lambda i: F.struct(window("w", i).alias("h"), window("v", i).alias("g"), literal(i).alias("literal")))
    return hashed(items, "item_id").select("item_id", F.posexplode(at).alias("ipos", "x")).select("item_id", "ipos", "x.h", "x.g", "x.literal")


def matches(docs: DataFrame, items: DataFrame, apart: bool = False) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, n_slots, n_matched, contaminated: every pair with a consistent window.

    n_windows counts canonical windows, n_matched those that match either way, n_slots the item's slots that consistent windows cover.
    apart: a row for each text of a doc_id, with its digest (xxhash64) as a further column. Rows without a doc_id or a text match nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").dropDuplicates(["item_id"])
    mine, _ = scratch.keep(item_windows(items))
    keys = mine.filter(F.col("literal") >= LITERAL).select("item_id", "ipos", "h", F.lit(True).alias("template"))
    keys = keys.unionByName(mine.filter("g <> h").select("item_id", "ipos", F.col("g").alias("h"), F.lit(False).alias("template")))
    small = keys.count() <= BROADCAST_WINDOWS
    docs = docs.filter("doc_id is not null and text is not null")
    near = docs.join(candidates(docs, items, scratch), "doc_id", "left_semi").select(F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("doc"), "text")
    joined = windows(near, "doc").join(F.broadcast(keys) if small else keys, "h")
    hits, _ = scratch.keep(joined.groupBy("doc", "pos", "item_id", "ipos").agg(F.max(F.col("canonical") & F.col("template")).alias("canonical")))
    # one row a document takes its words to its matches; a document's matches are bounded by its length and the items'
    found = hits.filter("canonical").groupBy("doc").agg(F.collect_list(F.struct("item_id", "ipos", "pos")).alias("at"))
    few = found.select("doc.doc_id").distinct()
    if few.count() <= BROADCAST_DOCS:
        few = F.broadcast(few)
    words = lambda rows, key, name: words_of(rows, key).select(key, F.split("m", " ").alias(name), "c")
    near = docs.join(few, "doc_id", "left_semi").select(F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("doc"), "text").dropDuplicates(["doc"])
    cut = words(near, "doc", "words").join(found, "doc").select("doc", F.explode(F.transform("at", lambda x: F.struct(x["item_id"].alias("item_id"), x["ipos"].alias("ipos"), F.slice("words", x["pos"] + 1, WINDOW).alias("there")))).alias("x"))
    slots = cut.select("doc", "x.*").join(words(items, "item_id", "here"), "item_id")
    slot = lambda k: F.struct(F.col("c")[F.col("ipos") + k].alias("kind"), F.col("here")[F.col("ipos") + k].alias("here"), F.col("there")[k].alias("there"), (F.col("ipos") + k).alias("place"))
    slots = slots.select("doc", "item_id", "ipos", F.filter(F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), slot), lambda x: x["kind"].isin("#", "@", "%")).alias("s"))
    kinds = lambda *names: F.size(F.array_distinct(F.transform("s", lambda x: F.struct(x["kind"], *[x[n] for n in names]))))
    sound = slots.filter((kinds("here") == kinds("here", "there")) & (kinds("there") == kinds("here", "there"))).select("doc", "item_id", "ipos", F.lit(True).alias("canonical"), F.transform("s", lambda x: x["place"]).alias("places"))
    lines = sound.unionByName(hits.filter("not canonical").select("doc", "item_id", "ipos", F.lit(False).alias("canonical"), F.array().cast("array<int>").alias("places")))
    # an item has a bounded number of windows, so the sets of places met are small
    keys = [F.col("doc.doc_id").alias("doc_id"), *([F.col("doc.digest").alias("digest")] if apart else []), "item_id"]
    pairs = lines.groupBy(*keys).agg(
        F.size(F.collect_set(F.when(F.col("canonical"), F.col("ipos")))).cast("long").alias("n_windows"), F.size(F.collect_set("ipos")).cast("long").alias("n_matched"),
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_slots"),
    )
    out = pairs.join(mine.groupBy("item_id").agg(F.count("*").alias("item_windows")), "item_id")
    return out.select(*pairs.columns[: len(keys)], "n_windows", "item_windows", "n_slots", "n_matched", ((F.col("n_matched") >= ENOUGH) | (2 * F.col("n_matched") >= F.col("item_windows"))).alias("contaminated"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).filter("contaminated").drop("n_matched", "contaminated")


def _sql_words(source: str, key: str) -> str:
    q = lambda s: s.replace("'", "''")
    t = f"translate(coalesce(text, ''), '{START}{POINT}', '  ')"
    t = f"regexp_replace({t}, '{q(SENTENCE)}', '\\1{START}\\2', 'g')"
    t = f"regexp_replace({t}, '{JOINED}', '{POINT}\\1', 'g')"
    t = f"trim(regexp_replace({t}, '{OUTSIDE}', ' ', 'g'))"
    c = f"lower(regexp_replace(regexp_replace(' ' || t, '{NUMBER}', ' #', 'g'), '{NAME}', ' @', 'g'))"
    c = f"replace(regexp_replace(replace({c}, ' ', '  ') || ' ', '{UNIT}', ' % ', 'g'), '{START}', '')"
    return f"SELECT {key}, string_split(t, ' ') AS r, CASE WHEN t = '' THEN []::VARCHAR[] ELSE string_split_regex(trim({c}), ' +') END AS c, CASE WHEN t = '' THEN []::VARCHAR[] ELSE string_split(lower(replace(t, '{START}', '')), ' ') END AS v FROM (SELECT {key}, {t} AS t FROM {source} WHERE {key} IS NOT NULL AND text IS NOT NULL)"


def _sql_windows(name: str, key: str, pos: str) -> str:
    return f"SELECT {key}, {pos}, array_to_string(c[{pos} + 1:{pos} + {WINDOW}], ' ') AS w, array_to_string(v[{pos} + 1:{pos} + {WINDOW}], ' ') AS x, len(list_filter(c[{pos} + 1:{pos} + {WINDOW}], lambda x: x NOT IN ('#', '@', '%'))) AS literal FROM (SELECT {key}, c, v, unnest(range(len(c) - {WINDOW - 1})) AS {pos} FROM {name} WHERE len(c) >= {WINDOW})"


OP8_SQL = f"""
WITH dw AS ({_sql_words("documents", "doc_id")}), iw AS ({_sql_words("benchmark", "item_id")}),
dx AS ({_sql_windows("dw", "doc_id", "pos")}), ix AS ({_sql_windows("iw", "item_id", "ipos")}),
hits AS (SELECT DISTINCT doc_id, item_id, pos, ipos FROM dx JOIN ix USING (w) WHERE ix.literal >= {LITERAL}),
filled AS (SELECT doc_id, item_id, ipos, list_transform(list_filter(range(1, {WINDOW + 1}), lambda k: iw.c[ipos + k] IN ('#', '@', '%')),
             lambda k: {{'kind': iw.c[ipos + k], 'here': iw.r[ipos + k], 'there': dw.r[pos + k], 'place': ipos + k}}) AS s
           FROM hits JOIN iw USING (item_id) JOIN dw USING (doc_id)),
lines AS (SELECT doc_id, item_id, ipos, s FROM filled
          WHERE len(list_distinct(list_transform(s, lambda x: [x.kind, x.here]))) = len(list_distinct(list_transform(s, lambda x: [x.kind, x.here, x.there])))
            AND len(list_distinct(list_transform(s, lambda x: [x.kind, x.there]))) = len(list_distinct(list_transform(s, lambda x: [x.kind, x.here, x.there])))),
found AS (SELECT doc_id, item_id, count(DISTINCT ipos) AS n_windows, len(list_distinct(flatten(list(list_transform(s, lambda x: x.place)))))::BIGINT AS n_slots FROM lines GROUP BY ALL),
sizes AS (SELECT item_id, count(*) AS item_windows FROM ix GROUP BY ALL),
keys AS (SELECT item_id, ipos, w AS k FROM ix WHERE literal >= {LITERAL} UNION SELECT item_id, ipos, x FROM ix WHERE x <> w),
either AS (SELECT doc_id, pos, w AS k FROM dx UNION SELECT doc_id, pos, x FROM dx),
plain AS (SELECT DISTINCT doc_id, item_id, pos, ipos FROM either JOIN keys USING (k) EXCEPT SELECT doc_id, item_id, pos, ipos FROM hits),
matched AS (SELECT doc_id, item_id, count(DISTINCT ipos) AS n_matched FROM (SELECT doc_id, item_id, ipos FROM lines UNION SELECT doc_id, item_id, ipos FROM plain) GROUP BY ALL)
SELECT doc_id, item_id, coalesce(n_windows, 0) AS n_windows, item_windows, coalesce(n_slots, 0) AS n_slots FROM matched JOIN sizes USING (item_id) LEFT JOIN found USING (doc_id, item_id)
WHERE n_matched >= {ENOUGH} OR 2 * n_matched >= item_windows
"""
