"""Spelling variants: words one edit apart, grouped under their most frequent form."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import HEAVY_SHARE, LOWER, UPPER
from tillsight.session import materialize

#: Second-level partitions of a letter multiset's dimensions.  Two of them are left out of
#: a signature of two words of one length, one where the lengths differ.
PARTITIONS = 4


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5, drop_one_in: int = 199,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: runs of letters of whole texts, A-Z lower-cased, with occurrences.

    Where ``drop_one_in`` divides the checksum of ``<id>:<run>``, the run loses the letter
    the checksum points at (a planted misspelling; 0: none).  Runs too short to become a
    word are never listed; counts are summed before the shuffle.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{max(min_chars, 1)},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    found = found.select("doc", F.when(ascii_only, F.lower("run")).otherwise(
        F.translate("run", UPPER, LOWER)).alias("run"))
    word = F.col("run")
    if drop_one_in:
        found = found.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        word = F.when(F.col("h") % drop_one_in == 0, shorter).otherwise(word)
    return (found.select(word.alias("word")).where(F.char_length("word") >= min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def _digests(word: Column, partitions: int) -> Column:
    """The word's letter multiset as a binary vector -- dimension (letter, how many of it
    came before) -- dealt over ``partitions`` by hash: one digest of the ones in each."""
    letters = F.array_sort(F.split(word, ""))
    ones = F.transform(letters, lambda c, i: F.xxhash64(c, i + 1 - F.array_position(letters, c)))

    def digest(p: int) -> Column:
        return F.aggregate(F.filter(ones, lambda x: F.pmod(x, F.lit(partitions)) == p), F.lit(0).cast("long"),
                           lambda a, x: a.bitwiseXOR(x))

    return F.array(*[digest(p) for p in range(partitions)])


def _signatures(words: DataFrame, left_out: int, extra: int, partitions: int) -> DataFrame:
    """``(key, word, n)``: one row per signature of the word.

    A signature enumerates which ``left_out`` partitions it ignores.  Two words whose
    vectors differ in at most that many dimensions agree on one of them.  One edit also
    leaves the first or the last half of the shorter word as it is, so the key holds a
    half, and the shorter word's length: the word's own less ``extra``.
    """
    short = F.char_length("word") - extra
    front = F.floor(short / 2).cast("int")
    halves = [F.substring("word", F.lit(1), front),
              F.substring("word", F.char_length("word") - (short - front) + 1, short - front)]
    keys = [F.xxhash64(F.lit(sum(1 << p for p in gone)), *[F.col("d")[p] for p in range(partitions) if p not in gone],
                       short, F.lit(h), half)
            for gone in combinations(range(partitions), left_out) for h, half in enumerate(halves)]
    return words.select("word", "n", F.explode(F.array(*keys)).alias("key"))


def _meet(a: DataFrame, b: DataFrame, condition: Column) -> DataFrame:
    """Rows of a and b with one key that fulfil ``condition``, which the join itself checks:
    pairs that fail it are never written.  A key with more than 1/HEAVY_SHARE of b's rows
    -- at most HEAVY_SHARE of them, a bounded broadcast -- is cut: a's rows are salted by
    word, b's go to every salt."""
    counts = b.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    share = max(1024, (b.count() // HEAVY_SHARE) + 1)
    heavy = F.broadcast(counts.where(F.col("m") > share).select("key", F.ceil(F.col("m") / share).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    left = (a.join(heavy, "key", "left").select("key", F.pmod(F.xxhash64("word"), salts).cast("int").alias("salt"),
                                                F.col("word").alias("a"), F.col("n").alias("na")))
    right = (b.join(heavy, "key", "left").select("key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"),
                                                 F.col("word").alias("b"), F.col("n").alias("nb")))
    return left.join(right, ["key", "salt"]).where(condition).select("a", "na", "b", "nb")


def near_pairs(words: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """``(a, na, b, nb)``: every two words one inserted, deleted or replaced letter apart, once.

    Such words' letter multisets, as binary vectors, are at Hamming distance at most two:
    two for a replaced letter, one for an inserted one.  PartEnum signatures find all of
    them by equality; the join verifies the edit distance of the words themselves, which
    anagrams and chance meetings fail.  ``words (word, n)`` is unique by word; it should be
    materialized.
    """
    vectors = materialize(words.select("word", "n", _digests(F.col("word"), partitions).alias("d")))
    one_edit = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    same = materialize(_signatures(vectors, 2, 0, partitions))
    shorter, longer = (materialize(_signatures(vectors, 1, e, partitions)) for e in (0, 1))
    replaced = _meet(same, same, (F.col("a") < F.col("b")) & one_edit)
    inserted = _meet(shorter, longer, one_edit)
    return replaced.unionByName(inserted).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for every word with a form: forms followed to the last one.

    A form is always more frequent than its word, so there are no circles; each round
    doubles the steps taken, until none moves.
    """
    roots = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialize(roots.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not roots.where("moved").limit(1).count():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def spelling_variants(docs: DataFrame, min_chars: int = 6, min_count: int = 5, times: int = 5, drop_one_in: int = 199,
                      partitions: int = PARTITIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per word of at least ``min_chars``
    code points and ``min_count`` occurrences.

    ``n_near`` counts the words one edit away.  The most frequent of them (of equals the
    first in code-point order) is the word's form if it occurs at least ``times`` as often;
    ``root`` is where following forms ends, the word itself without one.

    Null and empty texts have no words; a null id counts as an empty one; repeated rows
    are counted again; ids of any type are taken as text.  Other columns are not read.  An
    empty table gives no rows.
    """
    if times < 2:
        raise ValueError("times must be at least 2, or forms could run in a circle")
    words = materialize(word_counts(docs, min_chars, min_count, drop_one_in, id_col, text_col))
    pairs = materialize(near_pairs(words, partitions))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("m"), F.col("near"))).alias("best"))
    enough = -F.col("best.m") >= times * F.col("n")
    table = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")))
    roots = _roots(table.where(F.col("form").isNotNull()))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                    "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Written from the definition: checksums by the byte table, near words by equal deletions.
ORACLE = rf"""
WITH RECURSIVE bits(i, step, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT doc_id, translate(r, '{UPPER}', '{LOWER}') AS run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) GROUP BY 1, 2),
bytes AS (
  SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda ch:
    CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT]
         ELSE [(192 + (unicode(ch) >> 6))::BIGINT, (128 + (unicode(ch) & 63))::BIGINT] END)) AS b FROM runs WHERE length(run) >= 6),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
    xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
made AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
              ELSE run END AS word, k FROM hashed),
w AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
near AS (
  SELECT a.word, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.less = b.less AND a.p = b.p AND a.word <> b.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON cut.less = w.word
  UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON cut.less = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
chosen AS (
  SELECT best.word, best.m, min(encode(near.near)) AS form FROM best JOIN near ON near.word = best.word AND near.m = best.m
  GROUP BY 1, 2),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN chosen.m >= 5 * w.n THEN decode(chosen.form) END AS form,
         CASE WHEN chosen.m >= 5 * w.n THEN chosen.m END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word LEFT JOIN chosen ON chosen.word = w.word),
steps(word, reached) AS (
  SELECT word, word FROM f UNION ALL SELECT steps.word, f.form FROM steps JOIN f ON f.word = steps.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.form, steps.reached AS root, f.n, f.n_near, f.form_n
FROM f JOIN steps ON steps.word = f.word JOIN f AS ends ON ends.word = steps.reached AND ends.form IS NULL
"""
