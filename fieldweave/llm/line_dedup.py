"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words; it goes if the Jaccard similarity with an
earlier line (smaller document id, or the same document and a smaller line
number) reaches the threshold, whether or not that earlier line stays.

1. Words are counted in a table of fixed size, by hash. A word's key has the
   magnitude of its count in the high bits and its hash below, so sorted keys
   run from rare to frequent. Any order common to all lines gives the same
   result; this one makes prefixes rare.
2. Lines of equal sets form a class, known by its earliest line; the others go.
3. Classes meet where they share one of the first ``n - ceil(t n) + 1`` keys;
   keys that occur once in the corpus bring nobody. The join keeps pairs whose
   sizes fit (length filter), where the words after the common key suffice
   (positional filter), and which can have enough in common by signatures of
   128 bits of all their words.
4. Candidates are verified on their words.

Where many classes have one of their rarest keys in common, they are compared
with a few first ones, and with the one that most lines equal, beforehand:
lines that go then need not look for other reasons, so a group of many near
copies does not meet itself pair by pair.

Defined results: lines without a word are never removed; a null text stays
null and has no lines. Null ids come last in order. Rows that repeat an id are
one place: equal lines of equal number do not remove each other. An empty
table gives an empty result. Lines and texts of any length are used whole.
Columns may have any names; one named ``removed`` is replaced by the operator's.
Equality of words is that of their 57-bit hashes up to step 3.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import BLANKS, Scratch, apart, broadcast_if, table

#: The similarity threshold as a fraction of whole numbers.
NUM, DEN = 4, 5
#: Places of the table of counts; one byte each in a task.
BUCKETS, BLOCK = 1 << 20, 1 << 10
HASH_BITS = 57
#: Blanks but space and line feed.
OTHER_BLANKS = "\t\x0b\x0c\r"
#: Up to so many words a signature is 64 bits of all of them; beyond, 64 bits for each half.
SHORT = 56
#: How many of the rarest keys bring a class to the first comparison; the rarest few may be those of edits.
HEADS = 6
#: With how many first classes of a key the others are compared beforehand.
LEADERS = 6
#: The least number of classes that have such a key, and the magnitude that so many words have: fewer meet each other directly.
CROWDED, MAGNITUDE = 64, 7
#: Bits of the number of a line in that of its place.
LINE_BITS = 31
#: How many of a class's likeliest matches are verified before all others.
LIKELIEST = 2
#: Lines that are sent to every task at most, of some 32 bytes each, and numbers of removed lines, of 4 bytes and 40 for each document, which counts as two.
FEW, FEW_REMOVED = 300_000, 2_000_000


def tokens(line: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(line, BLANKS), ""))


def _spaced(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with every blank but line feeds as a space, so that words split at one character."""
    # plain searches for the four bytes cost a tenth of a regular expression's
    found = reduce(Column.__or__, [F.contains("text", F.lit(c)) for c in OTHER_BLANKS])
    text = F.when(found, F.regexp_replace("text", f"[{OTHER_BLANKS}]", " ")).otherwise(F.col("text"))
    return docs.where("text IS NOT NULL").select("doc_id", text.alias("text"))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1))


def magnitudes(docs: DataFrame, scratch: Scratch) -> Column:
    """A byte for each hash bucket, as a scalar subquery: 0 if one word at most was counted there, else one more than the binary logarithm of the count."""
    spark = docs.sparkSession
    words = _spaced(docs).select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counted = words.groupBy(_bucket(F.xxhash64("w")).alias("bucket")).count()
    size = F.when(F.col("count") > 1, F.floor(F.log2("count")) + 1).otherwise(0).cast("long")
    # eight sizes to a number, so that an eighth of the rows is gathered
    packed = counted.select(F.shiftright("bucket", 3).alias("eight"), F.call_function("shiftleft", size, (F.col("bucket").bitwiseAND(F.lit(7)) * 8).cast("int")).alias("sizes"))
    every = spark.range(BUCKETS // 8).select(F.col("id").alias("eight"), F.lit(0).cast("long").alias("sizes"))
    dense = packed.unionByName(every).groupBy("eight").agg(F.sum("sizes").alias("sizes"))
    apiece = dense.select("eight", F.array(*[F.shiftright("sizes", 8 * i).bitwiseAND(F.lit(127)).cast("tinyint") for i in range(8)]).alias("sizes"))
    in_order = lambda x: F.sort_array(F.collect_list(x))
    blocks = apiece.groupBy((F.col("eight") / (BLOCK // 8)).cast("int").alias("block")).agg(F.flatten(in_order(F.struct("eight", "sizes"))["sizes"]).alias("sizes"))
    whole = blocks.groupBy().agg(F.flatten(in_order(F.struct("block", "sizes"))["sizes"]).alias("sizes"))  # BUCKETS bytes
    return scratch.write(whole, "sizes").scalar()


def _keys(hashed: DataFrame, sizes: Column) -> DataFrame:
    """``hashed`` with its column ``h``, hashes of distinct words, as sorted ``keys``."""
    # The subquery stands in a projection of its own kind: a generator would get its whole value, a megabyte, with every row.
    own = [c for c in hashed.columns if c != "h"]
    # coalesce tells the optimizer that no key is null: numbers without nulls are sorted faster
    magnitude = lambda h: F.coalesce(F.get("sizes", _bucket(h).cast("int")), F.lit(0).cast("tinyint")).cast("long")
    key = lambda h: F.call_function("shiftleft", magnitude(h), F.lit(HASH_BITS)).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    return hashed.withColumn("sizes", sizes).select(*own, F.sort_array(F.transform("h", key)).alias("keys"))


def _hashes(words: Column) -> Column:
    return F.array_distinct(F.array_remove(F.transform(words, lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def _digests() -> list[Column]:
    return [F.xxhash64("keys").alias("d1"), F.xxhash64(F.lit(1), "keys").alias("d2")]


def keyed(docs: DataFrame, sizes: Column) -> DataFrame:
    """``doc_id, line_no, n, d1, d2, s1, s2, prefix`` of the lines with words.

    ``s1``, ``s2``: a signature of the words.
    """
    lines = _spaced(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # Exploding a single value keeps the optimizer from computing it again wherever it is used.
    hashed = lines.select("doc_id", "line_no", F.explode(F.array(_hashes(F.split("line", " ")))).alias("h")).where(F.size("h") > 0)
    # hashes of long lines in order, parted by a 0: which half a word's bit is in goes by the sign of its hash
    zero = F.lit(0).cast("long")
    parted = hashed.withColumn("signs", F.when(F.size("h") > SHORT, F.sort_array(F.concat("h", F.array(zero)))))
    keys = _keys(parted, sizes).select("doc_id", "line_no", "signs", F.explode(F.array("keys")).alias("keys")).withColumns({"n": F.size("keys"), "zero": F.array_position("signs", zero).cast("int")})
    prefix = F.when(F.col("n") >= DEN - 1, F.slice("keys", F.lit(1), _prefix(F.col("n")))).otherwise(F.array().cast("array<bigint>"))
    # six bits of a hash, which a shift takes by itself, say where in 64 bits
    at = lambda k: F.shiftright(k, HASH_BITS - 6).cast("int")
    bits = lambda some: F.aggregate(some, zero, lambda a, k: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at(k))))
    s1 = F.when(F.col("n") <= SHORT, bits("keys")).otherwise(bits(F.slice("signs", F.lit(1), F.col("zero") - 1)))
    s2 = F.when(F.col("n") <= SHORT, zero).otherwise(bits(F.slice("signs", F.col("zero") + 1, F.col("n"))))
    return keys.select("doc_id", "line_no", "n", *_digests(), s1.alias("s1"), s2.alias("s2"), prefix.alias("prefix"))


def _prefix(n: Column) -> Column:
    return (n - F.ceil(n * NUM / F.lit(DEN)) + 1).cast("int")


def _fits(n: Column, m: Column) -> Column:
    return (DEN * n >= NUM * m) & (DEN * m >= NUM * n)


def _need(n: Column, m: Column) -> Column:
    """The least number of common words of sets of ``n`` and ``m`` that reaches the threshold."""
    return F.ceil(NUM * (n + m) / F.lit(NUM + DEN))


def _behind(x: str, y: str) -> Column:
    """The most words that sets can share if a key at these places is the first they share."""
    return 1 + F.least(F.col(f"{x}.n") - F.col(f"{x}.place") - 1, F.col(f"{y}.n") - F.col(f"{y}.place") - 1)


def _possible(x: str, y: str) -> Column:
    """Sizes fit, what follows the places suffices if this key is the first that both share, and signatures leave enough in common."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    need = _need(n, m)

    def lacking(one: str, two: str) -> Column:
        """The bits that the other set lacks: at least as many words are not in it."""
        whole = [F.col(f"{side}.s1").bitwiseOR(F.col(f"{side}.s2")) for side in (one, two)]
        halves = [F.bit_count(F.col(f"{one}.{s}").bitwiseAND(F.bitwise_not(F.col(f"{two}.{s}")))) for s in ("s1", "s2")]
        return F.when(F.least(n, m) <= SHORT, F.bit_count(whole[0].bitwiseAND(F.bitwise_not(whole[1])))).otherwise(halves[0] + halves[1])

    # different sets of one size differ in a word of each
    reachable = need <= F.least(n, m) - (n == m).cast("int")
    return _fits(n, m) & reachable & (_behind(x, y) >= need) & (lacking(x, y) <= n - need) & (lacking(y, x) <= m - need)


def words_of(docs: DataFrame, pairs: DataFrame, classes: DataFrame, sizes: Column, name: str) -> DataFrame:
    """``cls, words`` of the classes in ``pairs(later, earlier)``, from the line that is a class's place."""
    scratch = Scratch(docs.sparkSession, name)
    asked = pairs.select(F.col("later").alias("cls")).union(pairs.select("earlier")).distinct().join(classes.select("cls", "doc_id", "line_no", "d1", "d2"), "cls")
    asked = scratch.write(asked.select("cls", F.col("doc_id").alias("w_doc"), F.col("line_no").alias("w_line"), F.col("d1").alias("w1"), F.col("d2").alias("w2")), "wanted")
    of_doc = asked.groupBy("w_doc").agg(F.collect_list(F.struct("w_line", "cls", "w1", "w2")).alias("wanted"))
    wanted = broadcast_if(of_doc, asked.count(), FEW)
    split = docs.where("text IS NOT NULL").join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc"))).select("wanted", F.explode(F.array(F.split("text", "\n"))).alias("lines"))
    lines = split.select(F.explode(F.transform("wanted", lambda w: F.struct(w["cls"].alias("cls"), w["w1"].alias("w1"), w["w2"].alias("w2"), F.get("lines", w["w_line"]).alias("line")))).alias("a")).select("a.*")
    found = lines.where("line IS NOT NULL").select("cls", "w1", "w2", F.explode(F.array(tokens(F.col("line")))).alias("words"))
    # Rows that repeat an id may have other lines at the place; only the class's own count.
    own = _keys(found.withColumn("h", _hashes(F.col("words"))), sizes).withColumns(dict(zip(("d1", "d2"), _digests(), strict=True))).where("d1 = w1 AND d2 = w2")
    words = scratch.write(own.select("cls", "words"), "words")
    scratch.release()
    return words


def similar(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``gone``: the later classes of the pairs that reach the threshold, by their words."""
    later = words.select(F.col("cls").alias("later"), F.col("words").alias("x"))
    earlier = words.select(F.col("cls").alias("earlier"), F.col("words").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    right = pairs.join(later, "later").join(earlier, "earlier").withColumn("both", both).where(DEN * F.col("both") >= NUM * (F.size("x") + F.size("y") - F.col("both")))
    return right.select(F.col("later").alias("gone")).distinct()


def numbered(lines: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Classes of equal lines with the place of the earliest one and a number ``cls`` that runs in order of place.

    ``prefix`` is without its keys that occur once, which come first; ``single`` counts them.
    """
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    low, high = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first() if whole else (None, None)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no")
    span = 0 if low is None else high - low + 1
    if whole and span < 1 << LINE_BITS:  # the place itself is a number; that of no id comes last
        doc = F.coalesce(F.col("doc_id").cast("long") - (low or 0), F.lit(span).cast("long"))
        place = F.call_function("shiftleft", doc, F.lit(LINE_BITS)).bitwiseOR(F.col("line_no").cast("long"))
    grouped = lines.groupBy("d1", "d2", "n").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("lines"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("prefix").alias("prefix"))
    if whole and span < 1 << LINE_BITS:
        doc = F.shiftright("at", LINE_BITS)
        doc = F.when(doc < span, doc + (low or 0)).cast(docs.schema["doc_id"].dataType)
        own = [F.col("at").alias("cls"), doc.alias("doc_id"), F.col("at").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int").alias("line_no")]
    else:  # partitions are ranges of places, in order
        grouped = scratch.write(grouped, "grouped").orderBy("at")  # what orders rows reads them twice
        own = [F.monotonically_increasing_id().alias("cls"), F.col("at.doc_id").alias("doc_id"), F.col("at.line_no").alias("line_no")]
    once = F.lit(1 << HASH_BITS)  # keys below are of magnitude 0
    single = F.when(F.coalesce(F.get("prefix", F.lit(0)) >= once, F.lit(True)), 0).otherwise(F.size(F.filter("prefix", lambda k: k < once)))
    ordered = grouped.select(*own, "d1", "d2", "n", "lines", "s1", "s2", single.alias("single"), "prefix")
    left = F.when(F.col("single") > 0, F.slice("prefix", F.col("single") + 1, F.size("prefix"))).otherwise(F.col("prefix"))
    return scratch.write(ordered.withColumn("prefix", left), "classes")


def removed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, removed``: the numbers of the lines that go, for documents that lose any."""
    scratch = Scratch(docs.sparkSession, "lines")
    sizes = magnitudes(docs, scratch)
    lines = scratch.write(keyed(docs, sizes), "keyed")
    scratch.release()
    classes = numbered(lines, docs, scratch)
    places = scratch.write(lines.select("doc_id", "line_no", "d1", "d2", "n"), "places")
    scratch.drop("keyed", "grouped")
    scratch.release()

    # Against the first classes, one for each remainder, and that of most lines, that have the same keys
    rarest = F.slice("prefix", 1, HEADS)
    busy = classes.select(F.explode(rarest).alias("key")).where(F.col("key") >= (MAGNITUDE << HASH_BITS)).groupBy("key").count().where(F.col("count") >= CROWDED)
    busy = scratch.write(busy.select("key"), "busy")
    heads = classes.select("cls", "n", "lines", "s1", "s2", F.posexplode(rarest).alias("place", "key"), "single").withColumn("place", F.col("place") + F.col("single"))
    heads = heads.join(broadcast_if(busy, busy.count(), FEW), "key")
    own = F.struct("cls", "n", "place", "s1", "s2")
    first = [F.min(F.when(F.pmod(F.xxhash64("cls"), F.lit(LEADERS)) == r, own)).alias(f"y{r}") for r in range(LEADERS)]
    leaders = heads.groupBy("key").agg(*first, F.max(F.struct("lines", (-F.col("cls")).alias("early"), own.alias("own")))["own"].alias("most"))
    leaders = leaders.select("key", F.explode(F.array_distinct(F.array_compact(F.array("most", *[f"y{r}" for r in range(LEADERS)])))).alias("y"))
    near = heads.select("key", own.alias("x")).join(leaders, "key")
    near = near.where((F.col("x.cls") > F.col("y.cls")) & _possible("x", "y"))
    near = scratch.write(near.select(F.col("x.cls").alias("later"), F.col("y.cls").alias("earlier")).distinct(), "near")
    gone = scratch.write(similar(near, words_of(docs, near, classes, sizes, "near-words")), "gone")
    scratch.release()

    # All classes that are left, against all that are earlier
    marked = classes.join(gone, F.col("cls") == F.col("gone"), "left").select("cls", "n", "s1", "s2", F.col("gone").isNull().cast("int").alias("open"), "single", "prefix")
    meeting = marked.select("cls", "n", "s1", "s2", "open", "single", F.posexplode("prefix").alias("at", "key")).select("cls", "n", "s1", "s2", "open", (F.col("at") + F.col("single")).alias("place"), "key")
    x, y = meeting.alias("x"), meeting.alias("y")
    # Both sides need the same columns and neither is filtered by itself, so that both read one shuffle.
    condition = (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") > F.col("y.cls")) & (2 * F.col("x.open") > F.col("y.open")) & _possible("x", "y")
    met = x.join(y.hint("merge"), condition).groupBy(F.col("x.cls").alias("later"), F.col("y.cls").alias("earlier")).agg(F.count(F.lit(1)).alias("common"))
    pairs = scratch.write(met, "pairs")
    scratch.release()
    words = words_of(docs, pairs, classes, sizes, "pair-words")
    lost = [gone]
    # First each class's likeliest match: one is enough, so a group of near copies need not be verified pair by pair
    for turn in range(LIKELIEST):
        best = pairs.groupBy("later").agg(F.max(F.struct("common", (-F.col("earlier")).alias("first"))).alias("best")).select("later", (-F.col("best.first")).alias("earlier"))
        lost.append(scratch.write(similar(best, words), f"lost{turn}"))
        left = pairs.join(lost[-1], F.col("later") == F.col("gone"), "left_anti").join(best, ["later", "earlier"], "left_anti")
        pairs = scratch.write(left, f"pairs{turn}")
        scratch.release()
    lost = scratch.write(reduce(DataFrame.union, [*lost, similar(pairs, words)]), "lost")
    scratch.release()
    of_class = classes.join(lost, F.col("cls") == F.col("gone"), "left").select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), F.col("n").alias("k_n"), F.col("doc_id").alias("k_doc"), F.col("line_no").alias("k_line"), F.col("gone").isNotNull().alias("lost"))
    same = (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")) & (F.col("n") == F.col("k_n"))
    again = F.col("lost") | ~F.col("doc_id").eqNullSafe(F.col("k_doc")) | (F.col("line_no") != F.col("k_line"))
    going = places.join(of_class, same).where(again)
    out = scratch.write(going.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed")), "removed")
    scratch.drop("places", "classes", "busy", "pairs", "near", "gone", "lost")
    scratch.release()
    return out


def deduplicated(docs: DataFrame) -> tuple[DataFrame, str]:
    """All columns of ``docs``, in order, the text's repeated lines taken out, and one more with the numbers of those lines; its name."""
    plain = apart(docs, "doc_id", "text")
    gone = removed_lines(plain.select("doc_id", "text")).select(F.col("doc_id").alias("_id"), F.col("removed").alias("_removed"))
    gone = broadcast_if(gone, gone.agg(F.coalesce(F.sum(F.size("_removed") + 2), F.lit(0))).first()[0], FEW_REMOVED)
    left = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_removed", i))
    text = F.when(F.col("_removed").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    kept = plain.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<int>")
    return kept.select(*[text.alias(c) if c == "text" else F.col(c) for c in plain.columns], F.coalesce("_removed", none).alias("_removed")), "_removed"


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the text's repeated lines taken out, and ``removed``, the numbers of those lines."""
    found, removed = deduplicated(docs)
    kept = [i for i, c in enumerate(docs.columns) if c.lower() != "removed"]
    return found.select(*[F.col(found.columns[i]) for i in kept], removed).toDF(*[docs.columns[i] for i in kept], "removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, line_no, list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS ws FROM l),
sets AS (SELECT list_sort(ws) AS ws, min((doc_id, line_no)) AS pos FROM t WHERE len(ws) > 0 GROUP BY 1),
numbered AS (SELECT row_number() OVER (ORDER BY pos) AS c, pos, ws, len(ws) AS n FROM sets),
words AS (SELECT c, n, unnest(ws) AS w FROM numbered),
often AS (SELECT w, count(*) AS f FROM words GROUP BY w),
placed AS (SELECT c, n, w, row_number() OVER (PARTITION BY c ORDER BY f, w) AS p FROM words JOIN often USING (w)),
prefix AS (SELECT c, n, w FROM placed WHERE p <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT x.c AS later, y.c AS earlier FROM prefix x JOIN prefix y ON x.w = y.w AND x.c > y.c AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n),
lost AS (SELECT DISTINCT later FROM (SELECT later, len(list_intersect(a.ws, b.ws)) AS k, a.n + b.n AS m FROM pairs JOIN numbered a ON a.c = later JOIN numbered b ON b.c = earlier) WHERE 5 * k >= 4 * (m - k)),
gone AS (SELECT doc_id, line_no FROM t JOIN numbered ON list_sort(t.ws) = numbered.ws LEFT JOIN lost ON later = c WHERE later IS NOT NULL OR (doc_id, line_no) <> pos),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM l ANTI JOIN gone USING (doc_id, line_no) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
