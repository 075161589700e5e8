"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good, votes bad or abstains on a document.  Expectation-maximisation over the counts of vote patterns estimates how accurate each rule's votes
are on good and on bad documents, and how common good documents are, over the documents that pass the base rules; a document is kept if it passes them and its posterior probability of being good reaches the threshold, so that one failing rule does
not reject what the others speak for.  There are at most 3**7 patterns, whatever the number of documents: EM runs as one expression over them, and their
posteriors are broadcast.

Words are `[^\\x20\\x09-\\x0D]+`.  Repeated 3-word windows are found by sorting 64-bit hashes with their positions within a document.

Defined cases: null and wordless texts have no words and fail the base rules; rows, nulls and repeats are kept one for one, and those
that pass the base rules count in the estimates, as in the SQL; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

SPACE = "[\\x20\\x09-\\x0D]+"
#: (rule, expression that votes bad, expression that votes good); bad comes first; neither: abstains.
RULES = [
    ("length", "n_words < 50", "n_words >= 80"),
    ("word_length", "10 * word_chars < 25 * n_words OR 10 * word_chars > 120 * n_words OR n_words = 0", "10 * word_chars >= 35 * n_words AND 10 * word_chars <= 90 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words", "100 * n_symbols <= 2 * n_words"),
    ("dup_lines", "100 * n_dup_lines > 30 * n_lines", "n_dup_lines = 0 AND n_lines > 1"),
    ("repeats", "100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words <= 20 * n_words"),
    ("capitals", "100 * n_upper > 30 * word_chars", "100 * n_upper <= 10 * word_chars"),
    ("line_ends", "100 * n_ended < 30 * n_lines", "100 * n_ended >= 60 * n_lines"),
]
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
ROUNDS, THRESHOLD = 20, 0.5
START = 0.9
#: Votes (bad, abstaining, good) that are counted in advance for good and bad documents; they tell the two kinds apart.
PRIOR = {"g": (1.0, 4.0, 5.0), "b": (5.0, 4.0, 1.0)}


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array."""

    def counted(w: Column) -> Column:
        hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return let(F.sort_array(hashes), covered)

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"))
        return F.aggregate(places, zero, step, lambda acc: acc["n"].cast("long"))

    return let(words, counted)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that the rules read, for each row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    by_line = let(
        lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(F.filter(x, lambda y: y.rlike("[.!?][\"')]*[\\x20\\x09-\\x0D]*$"))).cast("long").alias("n_ended"))
    )
    only = lambda but: F.char_length(F.regexp_replace("text", but, "")).cast("long")
    rows = own.select("doc_id", counted.alias("w"), by_line.alias("l"), only(SPACE).alias("word_chars"), only("[^#*$%&|<>]+").alias("n_symbols"), only("[^A-Z]+").alias("n_upper"))
    return rows.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "n_upper", "l.n_lines", "l.n_ended")


def pattern() -> Column:
    """All votes as one number: 0 bad, 1 abstains, 2 good, of rule j times 3**j."""
    return sum((F.expr(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END") * 3**j for j, (_, bad, good) in enumerate(RULES)), F.lit(0)).cast("int")


def cast(code: Column, j: int) -> Column:
    """Rule j's vote in a pattern: 0 bad, 1 abstains, 2 good."""
    return F.floor(code / 3**j) % 3


def estimated(counts: DataFrame) -> DataFrame:
    """One row: `votes`, the estimated P(vote | good) and P(vote | bad) of each rule; `prior`, the share of good documents; and `posts`, (code, n, post) of
    each pattern.  counts: (code, n)."""
    k = len(RULES)

    def posterior(x: Column, state: Column) -> Column:
        odds = sum((F.element_at(state[f"w{j}"], (cast(x["code"], j) + 1).cast("int")) for j in range(k)), state["prior"])
        return F.struct(x["code"].alias("code"), x["n"].alias("n"), (1 / (1 + F.exp(-odds))).alias("post"))

    def step(posts: Column) -> Column:
        """The maximisation: from posteriors to log odds of each vote."""
        names = [(y, j, a) for y in "gb" for j in range(k) for a in range(3)]
        zero = F.struct(*[F.lit(0.0).alias(f"{y}{j}{a}") for y, j, a in names], F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))

        def add(acc: Column, x: Column) -> Column:
            part = {"g": x["n"] * x["post"], "b": x["n"] * (1 - x["post"])}
            each = [(acc[f"{y}{j}{a}"] + F.when(cast(x["code"], j) == a, part[y]).otherwise(F.lit(0.0))).alias(f"{y}{j}{a}") for y, j, a in names]
            return F.struct(*each, (acc["good"] + part["g"]).alias("good"), (acc["bad"] + part["b"]).alias("bad"))

        def after(acc: Column) -> Column:
            chance = lambda y, j, a: (acc[f"{y}{j}{a}"] + PRIOR[y][a]) / (acc["good" if y == "g" else "bad"] + sum(PRIOR[y]))
            weights = [F.array(*[F.log(chance("g", j, a)) - F.log(chance("b", j, a)) for a in range(3)]).alias(f"w{j}") for j in range(k)]
            return F.struct(F.log((acc["good"] + 1) / (acc["bad"] + 1)).alias("prior"), *weights)

        return F.aggregate(posts, zero, add, after)

    def round_of(posts: Column) -> Column:
        return let(step(posts), lambda state: F.transform(posts, lambda x: posterior(x, state)))

    # The start: a document is likely bad if any rule says so.
    some_bad = lambda x: sum((F.when(cast(x["code"], j) == 0, 1).otherwise(0) for j in range(k)), F.lit(0)) > 0
    start = lambda p: F.transform(p, lambda x: F.struct(x["code"].alias("code"), x["n"].alias("n"), F.when(some_bad(x), F.lit(1 - START)).otherwise(F.lit(START)).alias("post")))
    table = counts.agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("p"))  # at most 3**k patterns
    last = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start(F.col("p")), lambda posts, _: round_of(posts))
    final = table.select(let(last, lambda posts: F.struct(posts.alias("posts"), step(posts).alias("state"))).alias("f"))
    return final.select(F.struct(*[F.col(f"f.state.w{j}").alias(name) for j, (name, *_) in enumerate(RULES)]).alias("votes"), (1 / (1 + F.exp(-F.col("f.state.prior")))).alias("prior"), F.col("f.posts").alias("posts"))


def judged(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the measures, base_failed, posterior and kept, for each row."""
    base = scratch(docs.sparkSession, "quality")
    own = written(measures(docs).withColumn("code", pattern()), f"{base}/measures")
    posts = estimated(own.where(~F.expr(BASE_FAILED)).groupBy("code").agg(F.count("*").alias("n"))).select(F.explode("posts").alias("x")).select("x.code", F.col("x.post").alias("posterior"))
    rows = own.join(F.broadcast(posts), "code", "left")  # at most 3**7 rows
    failed = F.expr(BASE_FAILED)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.coalesce("posterior", F.lit(0.0)) >= threshold)).alias("kept"), "posterior")


def kept_only(docs: DataFrame, judgements: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs whose doc_id is kept in every judged row of that id."""
    keep = judgements.groupBy("doc_id").agg(F.min("kept").alias("kept")).where("kept").select(F.col("doc_id").alias("__id"))
    return docs.join(keep, docs[id_col].eqNullSafe(F.col("__id")), "left_semi")


def sql() -> str:
    """The query in DuckDB's SQL; EM is unrolled."""
    k = len(RULES)
    v = lambda j: f"((code // {3**j}) % 3)"
    code = " + ".join(f"(CASE WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END) * {3**j}" for j, (_, bad, good) in enumerate(RULES))
    out = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, len(ws) AS n_words, ws FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
t AS (SELECT r, i, ws[i:i+2] AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM t) WHERE c > 1) GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (
  SELECT d.doc_id, w.n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper, len(ls) AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '[.!?]["'')]*[\\x20\\x09-\\x0D]*$'))) AS n_ended
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r)
),
c AS (SELECT *, {code} AS code FROM m),
p AS (SELECT code, CAST(count(*) AS DOUBLE) AS n FROM c WHERE NOT ({BASE_FAILED}) GROUP BY code),
e0 AS (SELECT code, n, CASE WHEN {" OR ".join(f"{v(j)} = 0" for j in range(k))} THEN {1 - START:.1f}::DOUBLE ELSE {START}::DOUBLE END AS post FROM p)"""
    for i in range(1, ROUNDS + 1):
        chance = lambda y, j, a: f"ln((sum(CASE WHEN {v(j)} = {a} THEN n * {'post' if y == 'g' else '(1 - post)'} ELSE 0 END) + {PRIOR[y][a]}) / (sum(n * {'post' if y == 'g' else '(1 - post)'}) + {sum(PRIOR[y])}))"
        weights = ", ".join(f"{chance('g', j, a)} - {chance('b', j, a)} AS w{j}_{a}" for j in range(k) for a in range(3))
        odds = " + ".join(f"CASE {v(j)} WHEN 0 THEN w{j}_0 WHEN 1 THEN w{j}_1 ELSE w{j}_2 END" for j in range(k))
        out += f""",
s{i} AS MATERIALIZED (SELECT ln((sum(n * post) + 1) / (sum(n * (1 - post)) + 1)) AS prior, {weights} FROM e{i - 1}),
e{i} AS MATERIALIZED (SELECT code, n, 1 / (1 + exp(-(prior + {odds}))) AS post FROM p, s{i})"""
    return out + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND coalesce(post, 0) >= {THRESHOLD} AS kept
FROM c LEFT JOIN e{ROUNDS} USING (code)
"""
