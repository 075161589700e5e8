"""Personal data: patterns find entities, and information-theoretic sanitisation finds the terms that give them away.  DataFrame functions only.

Entities are e-mail addresses, IPv4 addresses, payment cards and phone numbers: leftmost non-overlapping matches of each pattern, of which those that fail their check
are dropped.  The patterns here are the same languages with possessive quantifiers and with guards that let a match start only where a run starts, so that no
text makes them back-track.

Terms (after Sanchez and Batet's PMI-based sanitisation): a term is a word of a document that holds an entity.  Over all documents, with N documents, n_e holding entity e,
n_t holding term t and n_et holding both, e holds log2(N/n_e) bits and t tells log2(N n_et / (n_e n_t)) of them.  A term that tells at least GENERALISE of e's bits, and meets
e more often than chance allows, is generalised wherever it stands in documents that hold e, to the class of terms that are about as common (1, 10, 100, ... documents or more); from REMOVE on it is removed.  Chance: were e and t independent,
n_et or more common documents had a probability of at most exp(-(n_et ln(n_et / m) - n_et + m)) with m = n_e n_t / N (Chernoff); it has to be at most CHANCE.
Entities of the same documents tell the same, and are looked at as one.  Since n_et <= n_e, t can only tell as much if n_t <= N (n_e / N)^GENERALISE: other pairs are never made, and none is lost by that. A string of LONG digits or more that matched a pattern but failed its check is a term like any
word, named by its digits: it stays where no entity is, and where it tells too little.

Positions are code points, ends are exclusive.  Defined cases: null counts as empty and has no spans; rows, nulls and repeats are kept one for one and count as
documents; an empty table gives an empty result; other columns are not read, or kept by `sanitised`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_apart, scratch, written

KINDS = ["email", "ip", "card", "phone", "term"]
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\\.[{LABEL}]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match it.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
WORD = "\\p{L}{3,}"
#: Addresses, words of ASCII letters, and others; a word beyond ASCII that runs into an address is matched with it.
TOKENS = f"{PATTERNS['email']}|[A-Za-z]{{3,}}+(?!\\p{{L}})|\\p{{L}}{{3,}}+(?:(?<=[A-Za-z])[{LOCAL}]*+@[{LABEL}]++(?:\\.[{LABEL}]++)++)?+"
CHANCE, GENERALISE, REMOVE, LONG = 0.01, 0.8, 0.95, 9
SPAN = "struct<k:int,s:int,e:int,v:string>"
TERM = KINDS.index("term")
BLOCK = 64


def let(x: Column, f) -> Column:
    """f of x, with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def before(x: Column) -> Column:
    """For each element of an array of ints, the sum of those before it.  Blocks keep the work far below the square of the array's size."""

    def by_block(sums: Column) -> Column:
        starts = F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
        return let(starts, lambda at: F.transform(x, lambda _, i: F.get(at, F.floor(i / BLOCK).cast("int")) + total(F.slice(x, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))

    return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))), by_block)


def matches(text: Column, pattern: str, needs: str | None = None) -> Column:
    """array<struct<s, e, v>>: the pattern's leftmost non-overlapping matches.  split() cuts the text at the same matches that regexp_extract_all() returns, which
    gives their positions."""
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
        return let(gaps, lambda g: let(F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: a + F.char_length(b)), lambda step: let(before(step), lambda at: F.transform(m, lambda v, i: F.struct((F.get(at, i) + F.get(g, i)).alias("s"), (F.get(at, i) + F.get(step, i)).alias("e"), v.alias("v"))))))

    found = let(own, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))
    return found if needs is None else F.when(F.contains(text, F.lit(needs)), found).otherwise(none)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]+", "")


def passes(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(f"^(?:{BYTE}\\.){{3}}{BYTE}$")
    n = F.char_length(digits(v))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), F.call_function("luhn_check", digits(v))).otherwise(F.lit(False))
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def entities(text: Column) -> Column:
    """struct<email, ip, card, phone: array of valid spans, more: array of failing strings of LONG digits or more>; v is the entity's name, or # and digits."""

    def named(kind: str, found: Column) -> Column:
        name = {"email": F.lower, "ip": lambda v: v}.get(kind, digits)
        return F.transform(F.filter(found, lambda x: passes(kind, x["v"])), lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit(f"{kind}:"), name(x["v"])).alias("v")))

    def failing(kind: str, found: Column) -> Column:
        return F.transform(F.filter(found, lambda x: ~passes(kind, x["v"]) & (F.char_length(digits(x["v"])) >= LONG)), lambda x: F.struct(F.lit(TERM).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit("#"), digits(x["v"])).alias("v")))

    raw = F.struct(*[matches(text, p, NEEDS.get(kind)).alias(kind) for kind, p in PATTERNS.items()])
    return let(raw, lambda r: F.struct(*[named(k, r[k]).alias(k) for k in PATTERNS], F.array_distinct(F.concat(*[failing(k, r[k]) for k in ("ip", "card", "phone")])).alias("more")))


PLACE = "array<struct<s:int,e:int,v:string>>"


def terms_of(text: Column, more: Column) -> Column:
    """array<struct<s, e, v>>: more, the failing strings of digits, and the words of a text that touch no entity, in lower case.  Of entities only e-mail addresses have letters; they are matched along with the words."""
    apart = F.filter(matches(text, TOKENS), lambda w: ~F.contains(w["v"], F.lit("@")))
    plain = lambda w, v: F.struct(w["s"].alias("s"), w["e"].alias("e"), v.alias("v"))
    return F.concat(F.transform(more, lambda w: plain(w, w["v"])), F.transform(apart, lambda w: plain(w, F.lower(w["v"]))))


def found(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __text (null: empty), __row, __found (entities) and __terms (of rows with an entity)."""
    own = docs.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn("__row", F.monotonically_increasing_id())
    own = own.withColumn("__found", F.when(F.col("__text").rlike("[@0-9]"), entities(F.col("__text"))).otherwise(F.struct(*[F.array().cast(f"array<{SPAN}>").alias(k) for k in [*PATTERNS, "more"]])))
    return own.withColumn("__terms", F.when(holds(), terms_of(F.col("__text"), F.col("__found.more"))).otherwise(F.array().cast(PLACE)))


def holds() -> Column:
    """Whether a row of found() holds an entity."""
    return sum((F.size(f"__found.{k}") for k in PATTERNS), F.lit(0)) > 0


def telling(docs: DataFrame, every: DataFrame, base: str, text_col: str = "text") -> DataFrame:
    """(__row, __told): for each row, the terms that tell at least GENERALISE of the information of an entity it holds, with the largest share told and the number of
    documents that hold them, dealt into about the root of their number of parts by a hash.  every: the rows of found(docs)."""
    rows = every.where(holds())
    n = float(max(docs.count(), 1))
    entity = F.array_distinct(F.flatten(F.array(*[F.transform(f"__found.{k}", lambda x: x["v"]) for k in PATTERNS])))
    own = rows.select(F.col("__row").alias("row"), F.explode(entity).alias("entity"))
    # An entity's documents, by their number and two hashes.  Entities of the same documents meet each term equally often.
    of = own.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y"))
    own = joined_apart(written(own, f"{base}/held"), written(of, f"{base}/entities-of"), "entity", "inner")
    own = written(own.select("row", "n_e", F.concat_ws(":", "n_e", "x", "y").alias("entity")).distinct(), f"{base}/entities")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))
    numbers = every.where(F.size("__found.more") > 0).select(F.explode(F.array_distinct(F.transform("__found.more", lambda x: x["v"]))).alias("term"))
    n_t = written(docs.select(F.explode(words).alias("term")).unionAll(numbers).groupBy("term").agg(F.count("*").alias("n_t")), f"{base}/counts")
    #: The largest n_t with which a term can tell GENERALISE of an entity in n_e documents; the factor is for rounding.
    most = lambda n_e: F.pow(n_e / n, F.lit(GENERALISE)) * n * (1 + 1e-9)
    widest = own.agg(F.coalesce(F.max(most(F.col("n_e"))), F.lit(0.0)).alias("x")).first()["x"]
    # The most common terms are in so many documents that they would crowd the join; there are at most 1,000 times the distinct terms of an average document.
    common = n_t.where(F.col("n_t") > max(widest, n / 1000)).select("term")
    terms = rows.select(F.col("__row").alias("row"), F.explode(F.array_distinct(F.transform("__terms", lambda w: w["v"]))).alias("term")).join(F.broadcast(common), "term", "left_anti")
    terms = terms.join(n_t.where(F.col("n_t") <= widest), "term")
    pairs = written(terms.join(own, "row").where(F.col("n_t") <= most(F.col("n_e"))), f"{base}/pairs")
    both = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    bits, chance = F.log2(n / F.col("n_e")), F.col("n_e") * F.col("n_t") / n
    # An entity that every document holds has no information to tell.
    told = F.when(bits > 0, F.log2(F.col("n_et") / chance) / bits).otherwise(F.lit(0.0))
    significant = F.col("n_et") * F.log(F.col("n_et") / chance) - F.col("n_et") + chance >= -math.log(CHANCE)
    risky = both.where(significant).select("entity", "term", told.alias("told")).where(F.col("told") >= GENERALISE)
    risky = written(risky.withColumn("pair", F.struct("entity", "term")).select("pair", "told"), f"{base}/risky")
    met = written(pairs.select("row", "term", "n_t", F.struct("entity", "term").alias("pair")), f"{base}/met")
    each = joined_apart(met, risky, "pair", "inner").groupBy("row", "term").agg(F.max("told").alias("told"), F.first("n_t").alias("n_t"))
    told = each.groupBy("row").agg(F.collect_list(F.struct("term", "told", "n_t")).alias("all"))
    return told.select(F.col("row").alias("__row"), _dealt(F.col("all")).alias("__told"))


def _part(term: Column, parts: Column) -> Column:
    return F.pmod(F.hash(term), parts)


def _dealt(entries: Column) -> Column:
    parts = F.ceil(F.sqrt(F.size(entries))).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.filter(entries, lambda x: _part(x["term"], parts) == k))


def told_of(term: Column) -> Column:
    """What __told has of a term, as an array of one struct or none."""
    return F.filter(F.get(F.col("__told"), _part(term, F.size("__told"))), lambda x: x["term"] == term)


def told_places() -> Column:
    """The places of a row's telling terms."""
    return F.when(F.col("__told").isNull(), F.array().cast(PLACE)).otherwise(F.filter("__terms", lambda w: F.size(told_of(w["v"])) > 0))


def _spelled(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _plain(x: Column) -> Column:
    return F.transform(x, lambda y: F.struct(y["k"].alias("k"), y["s"].alias("s"), y["e"].alias("e")))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, numbers of entities, base_sha256 and spans, for each row."""
    base = scratch(docs.sparkSession, "pii")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(found(own).select("doc_id", "__row", "__found", "__terms"), f"{base}/found")
    terms = telling(own, rows, base)
    basic = F.concat(*[_plain(F.col(f"__found.{k}")) for k in PATTERNS])
    more = F.transform(told_places(), lambda w: F.struct(F.lit(TERM).alias("k"), w["s"].alias("s"), w["e"].alias("e")))
    out = rows.join(terms, "__row", "left").withColumn("__basic", F.sort_array(basic))
    counts = [F.size(f"__found.{k}").cast("long").alias(f"n_{k}") for k in PATTERNS]
    return out.select("doc_id", *counts, F.sha2(_spelled(F.col("__basic")).cast("binary"), 256).alias("base_sha256"), _spelled(F.concat("__basic", F.sort_array(F.array_distinct(more)))).alias("spans"))


def highest(x: Column) -> Column:
    """For each element of an array of ints, the greatest of those up to it, in blocks as before() has them."""
    top = lambda part: F.array_max(part)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: top(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))

    def by_block(tops: Column) -> Column:
        starts = F.transform(tops, lambda _, b: F.coalesce(top(F.slice(tops, F.lit(1), b)), F.lit(-1)))
        return let(starts, lambda at: F.transform(x, lambda _, i: F.greatest(F.get(at, F.floor(i / BLOCK).cast("int")), top(F.slice(x, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)))))

    return let(blocks, by_block)


CHUNK = 4096


def _rewritten(text: Column, every: Column) -> Column:
    """text with its spans replaced, [EMAIL] and so on; spans that overlap are replaced as one, by the name of the first; removed terms leave nothing.  Spans are in order
    and a text is cut into chunks once, so that the work grows little faster than their number."""

    def rebuilt(spans: Column) -> Column:
        return let(highest(F.transform(spans, lambda x: x["e"])), lambda ends: let(firsts(spans, ends), lambda m: let(chunks, lambda own: put_together(m, ends, own))))

    def firsts(spans: Column, ends: Column) -> Column:
        """The spans that start behind all before them, with their numbers."""
        placed = F.transform(spans, lambda x, i: F.struct(x["s"].alias("s"), x["name"].alias("name"), i.alias("i")))
        return F.filter(placed, lambda x: (x["i"] == 0) | (x["s"] >= F.get(ends, x["i"] - 1)))

    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / CHUNK).cast("int")), lambda k: F.substring(text, k * CHUNK + 1, F.lit(CHUNK)))

    def between(own: Column, s: Column, e: Column) -> Column:
        low = F.floor(s / CHUNK).cast("int")
        return F.substring(F.array_join(F.slice(own, low + 1, F.greatest(F.floor((e - 1) / CHUNK).cast("int") - low + 1, F.lit(0))), ""), s - low * CHUNK + 1, e - s)

    def put_together(m: Column, ends: Column, own: Column) -> Column:
        pieces = F.transform(m, lambda x, k: F.concat(between(own, F.when(k == 0, 0).otherwise(F.get(ends, x["i"] - 1)), x["s"]), x["name"]))
        return F.concat(F.array_join(pieces, ""), between(own, F.element_at(ends, -1), F.char_length(text)))

    return let(F.sort_array(every), lambda spans: F.when(F.size(spans) == 0, text).otherwise(rebuilt(spans)))


def sanitised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with entities replaced by their kind, telling terms generalised to a class of terms, [TERM 10+] for those of 10 to 99 documents, or removed (strings of digits: replaced by [NUMBER]), and columns as they are.  Only rows with an entity
    meet the terms in a join."""
    base = scratch(docs.sparkSession, "pii-text")
    columns = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    text = f"c{columns.index(text_col)}"
    rows = written(found(renamed, text).drop("__text"), f"{base}/found")
    terms = telling(rows.select(text), rows, base, text)
    common = lambda n: F.concat(F.lit("[TERM "), F.pow(F.lit(10.0), F.floor(F.log10(n.cast("double") + 0.5))).cast("long").cast("string"), F.lit("+]"))
    called = lambda told: F.when(told["told"] >= REMOVE, F.lit("")).otherwise(common(told["n_t"]))
    name = lambda w: F.when(F.startswith(w["v"], F.lit("#")), F.lit("[NUMBER]")).otherwise(let(F.get(told_of(w["v"]), F.lit(0)), called))
    placed = F.transform(told_places(), lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), name(w).alias("name")))
    labelled = lambda k, label: F.transform(F.col(f"__found.{k}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(label).alias("name")))
    basic = [labelled(k, f"[{k.upper()}]") for k in PATTERNS]
    with_terms = rows.where(holds()).join(terms, "__row", "left")
    some = with_terms.withColumn(text, _rewritten(F.col(text), F.concat(*basic, placed)))
    rest = rows.where(~holds())
    keep = [f"c{i}" for i in range(len(columns))]
    return some.select(keep).unionAll(rest.select(keep)).toDF(*columns)
