"""Spelling variants: frequent words at one edit from each other, each led to the form that its text most likely meant.

The join is an even-partition pigeonhole: a word is cut in two segments by its length, and the segment that an edit
leaves whole fixes the other one's borders; that one is cut again in the same way, so that three of four pieces stand in
a key.  A word is indexed under the keys of its own length; it probes those of words of equal length (the same keys) and
of words that are one shorter, where what follows the inserted code point is looked up one position further on.  A
candidate of equal length differs in one piece alone.  One that is shorter is taken on the piece that holds the first
difference, so that no pair comes twice and none is shuffled to be deduplicated; the edit is verified on whole words.

Edge cases: null and empty texts have no words; a null doc_id counts as an empty id in the damage's key; repeated
rows count each; a run of any length is one word (keys are hashes); words that occur too seldom, or are too short,
have no near words and give no row; of near words with equal counts the least in code-point order is the form; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

#: A maximal run of letters: ASCII and the upper half of Latin-1.
RUN = r"([A-Za-zÀ-ÿ]+)"
#: One run in so many is damaged; shorter and rarer words are left out.
DAMAGED, SHORTEST, RAREST = 97, 5, 3
#: A form occurs so many times as often as the word that it stands for.
RATIO = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(doc_id: Column, run: Column) -> Column:
    """The lower-cased run, without one code point where its hash with the id says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(DAMAGED)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts that are long and frequent enough."""
    runs = docs.select(F.col("doc_id").alias("_id"), F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUN))).alias("_run"))
    out = runs.select(damaged(F.col("_id"), F.col("_run")).alias("word")).where(F.length("word") >= SHORTEST)
    return out.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= RAREST)


def _borders(length: Column) -> list[Column]:
    """Where the four pieces of a word of this length begin, and its end: two halves, each halved."""
    half = F.floor(length / 2)
    return [F.lit(0), F.floor(half / 2), half, half + F.floor((length - half) / 2), length]


def _keys(word: str, length: Column, shift: int) -> Column:
    """Four entries (piece, key), one for each piece that may differ: hashes of all that stands before and after it in
    a word of this length.  With shift 1 the word is one longer, and what follows stands one position further on."""
    at = [b.cast("int") for b in _borders(length)]
    w = F.col(word)
    return F.array(*(
        F.struct(F.lit(q).cast("tinyint").alias("piece"), F.xxhash64(F.lit(q), length, F.substring(w, F.lit(1), at[q]), F.substring(w, at[q + 1] + 1 + shift, F.length(w))).alias("key"))
        for q in range(4)
    ))


def near(words: DataFrame) -> DataFrame:
    """word, other, other_n: each ordered pair of words(word, n) at exactly one edit, once."""
    index = words.select(F.col("word").alias("b"), F.col("n").alias("bn"), F.explode(_keys("word", F.length("word"), 0)).alias("_e")).select("b", "bn", "_e.key")
    both = F.concat(
        F.transform(_keys("word", F.length("word"), 0), lambda e: F.struct(e["piece"].alias("piece"), e["key"].alias("key"), F.lit(0).alias("longer"))),
        F.transform(_keys("word", F.length("word") - 1, 1), lambda e: F.struct(e["piece"].alias("piece"), e["key"].alias("key"), F.lit(1).alias("longer"))),
    )
    probe = words.select(F.col("word").alias("a"), F.col("n").alias("an"), F.explode(both).alias("_e")).select("a", "an", "_e.*")
    found = probe.join(index, "key").where((F.col("a") != F.col("b")) & (F.length("a") == F.length("b") + F.col("longer")))
    to = F.lit(None).cast("int")
    for q, border in enumerate(_borders(F.length("b"))[1:]):
        to = F.when(F.col("piece") == q, border.cast("int")).otherwise(to)
    # The piece up to whose end both are equal does not hold the first difference: a later one does.
    first = (F.col("longer") == 0) | (F.col("piece") == 3) | (F.substring("a", F.lit(1), to) != F.substring("b", F.lit(1), to))
    found = found.where(first & (F.levenshtein("a", "b", 1) == 1))
    here = F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("other_n"))
    back = F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("other_n"))
    return found.select(F.explode(F.when(F.col("longer") == 1, F.array(here, back)).otherwise(F.array(here))).alias("_p")).select("_p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): the last word reached.  Each round doubles the steps taken; a form is at least
    twice as frequent as its word, so the rounds are few and there is no ring."""
    up = kept(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        nxt = up.join(up.select(F.col("word").alias("root"), F.col("root").alias("_far")), "root", "left")
        nxt = kept(nxt.select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved")), "forms")
        up = nxt.select("word", "root")
        if nxt.where("_moved").isEmpty():
            return up


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs(doc_id, text)."""
    all_words = kept(words(docs), "words")
    best = near(all_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("_best"))
    out = all_words.join(best, "word", "left")
    led = -F.col("_best.less") >= RATIO * F.col("n")
    out = kept(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("_best.other")).alias("form"), F.when(led, -F.col("_best.less")).alias("form_n")), "nearest")
    out = out.join(roots(out.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows by deletion: words of equal length that agree without their i-th code point, and words that a longer
#: one becomes without one.  The hash is worked out byte by byte.
ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY id, run),
hashed AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i+1])::BIGINT)), lambda s, b: xor(s >> 8, t[1 + (xor(s, b) & 255)]))) AS h FROM counted, crc),
words AS (SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM pairs),
led AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND k = 1),
walk AS (SELECT word, word AS at, form AS nxt FROM led UNION ALL SELECT w.word, l.word, l.form FROM walk w JOIN led l ON l.word = w.nxt)
SELECT l.word, l.form, walk.at AS root, l.n, l.n_near, l.form_n FROM led l JOIN walk ON walk.word = l.word AND walk.nxt IS NULL
"""
