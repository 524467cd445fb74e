"""Document fingerprints by SimHash, with SQL functions only.

Each term of a text (a word with the word after it) is hashed to 64 bits and votes with its weight on
every bit; the fingerprint has the bits on which the set votes outweigh the others. ``near_pairs`` finds all
fingerprints within a Hamming radius by permuted block tables, and ``with_links`` counts them for each document.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, salted_join

LEAST = -(1 << 63)
ROWS_A_BUCKET = 2048
MOST_BUCKETS = 8192
_TERMS = r"(?=(\S++\s++\S++))\S++"


def terms(text: Column) -> Column:
    """Words with the next word each; a text of fewer than two words is one term."""
    found = F.regexp_extract_all(text, F.lit(_TERMS), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.trim(text)))


def votes(term: Column) -> list[Column]:
    """Sums over a text's terms: the weight of all, then 32 of which each counts the votes for bit i in
    its lower and for bit i + 32 in its upper half. A term weighs its length, at most 16: a text would
    need 2^28 terms to fill a half."""
    h, w = F.xxhash64(term), F.least(F.length(term), F.lit(16)).cast("long") + 1
    pick = F.lit((1 << 32) | 1)
    return [F.sum(w).alias("w")] + [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(pick) * w).alias(f"v{i}") for i in range(32)]


def elected(prefix: str = "") -> Column:
    """The fingerprint from the sums of ``votes``: a long."""
    whole, half = F.col(f"{prefix}w"), F.lit((1 << 32) - 1)
    out = F.lit(0).cast("long")
    for i in range(32):
        v = F.col(f"{prefix}v{i}")
        out = out.bitwiseOR(F.when(v.bitwiseAND(half) * 2 > whole, F.lit(1 << i)).otherwise(0))
        high = 1 << (i + 32) if i < 31 else LEAST
        out = out.bitwiseOR(F.when(F.shiftrightunsigned(v, 32) * 2 > whole, F.lit(high).cast("long")).otherwise(0))
    return out


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the Hamming distance of two fingerprints stands for; 0 where it would be negative."""
    distance = F.bit_count(a.bitwiseXOR(b))
    return F.when(distance == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.cos(distance * F.lit(3.141592653589793 / 64))))


def _bucket(key: str, bounds: list[int]) -> Column:
    """How many of the sorted bounds are no greater than the key, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))

    def listed(x: list[int]) -> str:
        return f"transform(split('{','.join(map(str, x))}', ','), b -> cast(b as bigint))"

    upper = f"size(filter({listed(bounds[::step])}, b -> b <= {key}))"
    return F.expr(f"aggregate(array({upper}), 0, (s, i) -> if(i = 0, 0, (i - 1) * {step} + size(filter(slice({listed(bounds)}, (i - 1) * {step} + 1, {step}), b -> b <= {key}))))")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its fingerprint, that of its edited text, and their likeness to each other and to
    the next document's. In the edited text the last third of the code points gives way to the first as
    many of the next document by descending id (the first, after the last).

    A null text is empty; null ids come last; rows of one id are ordered by a hash of their text, and repeated
    rows follow each other. A table of one row is its own next. Other columns are ignored.

    Texts are shuffled once, by ranges of ids of about ``ROWS_A_BUCKET`` rows (their bounds are approximate
    quantiles of the ids). Each range also gets a copy of the first row of the range after it; everything
    else happens within a range.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("k"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    n = rows.count()
    size = max(1, min(MOST_BUCKETS, n // ROWS_A_BUCKET))
    cuts = rows.agg(F.percentile_approx("k", [i / size for i in range(1, size)] or [0.5], min(1_000_000, 50 * size)).alias("q")).first()["q"] if size > 1 else None
    rows = rows.withColumn("b", _bucket("k", sorted(set(cuts or []))))
    # one row a bucket, MOST_BUCKETS at most
    tops = sorted((r["b"], r["m"]) for r in rows.groupBy("b").agg(F.max("k").alias("m")).collect())
    after = [(tops[i - 1][1], tops[i][0]) for i in range(len(tops))]  # the range below; the top one after the lowest
    if after:
        halo = docs.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"(CAST('{k}' AS BIGINT), {b})" for k, b in after) + " AS h(top, to)")
        halo = rows.join(F.broadcast(halo), F.col("k") == F.col("top")).select("k", "doc_id", "t", F.col("to").alias("b"), F.lit(1).alias("halo"))
        rows = rows.withColumn("halo", F.lit(0)).unionByName(halo)
    else:
        rows = rows.withColumn("halo", F.lit(0))
    order = Window.partitionBy("b").orderBy("halo", F.col("k").desc(), F.xxhash64("t"), "t")
    rows = rows.select("*", F.row_number().over(order).alias("place"), F.lead("t").over(order).alias("next"))
    rows = rows.withColumn("n_chars", F.length("t").cast("long")).withColumn("edit", F.expr("concat(substr(t, 1, length(t) - cast(floor(length(t) / 3) as int)), coalesce(substr(next, 1, cast(floor(length(t) / 3) as int)), ''))"))
    rows = rows.select("b", "place", "halo", "doc_id", "n_chars", F.sha2("edit", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("t").alias("x")), F.struct(F.lit(1).alias("v"), F.col("edit").alias("x")))).alias("s"))
    keys = ["b", "place", "halo", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.where("not (halo = 1 and s.v = 1)").select(*keys, F.col("s.v").alias("v"), F.explode(terms(F.col("s.x"))).alias("term"))
    rows = rows.groupBy(*keys, "v").agg(*votes(F.col("term"))).select(*keys, "v", elected().alias("f"))
    rows = rows.groupBy(*keys).agg(F.max(F.when(F.col("v") == 0, F.col("f"))).alias("f"), F.max(F.when(F.col("v") == 1, F.col("f"))).alias("e"))
    rows = rows.withColumn("g", F.lead("f").over(Window.partitionBy("b").orderBy("place"))).where("halo = 0")
    named = [F.lpad(F.lower(F.hex(c)), 16, "0").alias(x) for c, x in (("f", "fingerprint"), ("e", "edited_fingerprint"))]
    return rows.select("doc_id", "n_chars", "edited_sha256", *named, likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("g")).alias("near_next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each distinct (id, text); a null text is empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("m"), F.explode(terms(F.col("t"))).alias("term"))
    return rows.groupBy("doc_id", "m").agg(*votes(F.col("term"))).select("doc_id", elected().alias("fingerprint"))


#: Rows of a block of a hot key; the list of hot keys is bounded, so it can be broadcast.
BLOCK, MOST_HOT = 512, 4096


def near_pairs(prints: DataFrame, radius: int = 3, blocks: int = 6, col: str = "fingerprint") -> DataFrame:
    """All pairs (a, b) of different fingerprints, a < b, that differ in at most ``radius`` bits, with the
    distance, each once. The 64 bits are cut into blocks; each choice of ``blocks - radius`` of them is a table keyed
    by these blocks, and any pair within the radius agrees on at least one table's key; it comes from the
    first such table. The rows of the ``MOST_HOT`` keys that have more than ``BLOCK`` meet in blocks of about that many,
    so that a hot key's work is spread. Keys are counted by partial aggregation; nulls are left out.
    """
    if not 0 < radius < blocks:
        raise ValueError("the radius is above 0 and below the number of blocks")
    prints = prints.select(F.col(col).cast("long").alias("f")).where("f is not null").distinct()
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:])]
    tables = [sum(c) for c in combinations(masks, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in tables]
    keyed = prints.select("f", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(m)) for m in signed])).alias("table", "key"))
    keyed = keyed.select("f", "table", F.xxhash64("table", "key").alias("place"))
    counts = keyed.groupBy("place").count().where(F.col("count") > BLOCK).orderBy(F.desc("count"), "place").limit(MOST_HOT)
    hot = [(r[0], -(-r[1] // BLOCK)) for r in counts.collect()]

    def near(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        a, b = a.withColumnRenamed("f", "a"), b.withColumnRenamed("f", "b").drop("table")
        differ = F.col("a").bitwiseXOR(F.col("b"))
        agreed = F.filter(F.array(*map(F.lit, signed)), lambda m, i: (i <= F.col("table")) & (m.bitwiseAND(differ) == 0))
        pairs = a.join(b, on).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius))
        own = F.element_at(F.array(*map(F.lit, signed)), F.col("table") + 1).bitwiseAND(differ) == 0
        return pairs.where(own & (F.size(agreed) == 1)).select("a", "b", F.bit_count(differ).alias("distance"))

    if not hot:
        return near(keyed, keyed, ["place"])
    parts = F.broadcast(prints.sparkSession.createDataFrame(hot, "place bigint, parts bigint"))
    rows = keyed.join(parts, "place", "left").withColumn("part", F.pmod(F.xxhash64("f"), F.col("parts")))
    cold, warm = rows.where("parts is null").select("f", "table", "place"), rows.where("parts is not null")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    a = warm.select("f", "table", "place", F.col("part").alias("s"), each.alias("t"))
    b = warm.select("f", "table", "place", each.alias("s"), F.col("part").alias("t"))
    return near(cold, cold, ["place"]).unionByName(near(a, b, ["place", "s", "t"]))


def with_links(rows: DataFrame, radius: int = 3) -> DataFrame:
    """``rows`` of ``edited`` and near_links: how many other fingerprints of the table are within the radius. Written
    once, as it is read three times."""
    rows = Scratch(rows.sparkSession).put(rows)
    signed = F.conv("fingerprint", 16, -10).cast("long")
    pairs = near_pairs(rows.select(signed.alias("fingerprint")), radius)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("f")).groupBy("f").agg(F.count("*").alias("near_links"))
    links = ends.select(F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "near_links")
    out = salted_join(rows, "fingerprint", "doc_id", links, "left")
    return out.select(*rows.columns, F.coalesce("near_links", F.lit(0)).alias("near_links"))
