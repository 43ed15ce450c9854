"""Mixing sources to target weights by Poisson replication.

A document of a source with rate r appears k times, k being Poisson(r) inverted at a
uniform number that a hash of the seed and the document's id gives. So a document's
count depends on nothing but its id, the seed and its source's rate.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, free, stored

#: Rates above this are drawn as a sum of equal parts, as exp(-rate) would vanish.
LARGEST_RATE = 256.0
#: Most sources whose table is broadcast.
BROADCAST_SOURCES = 10_000
#: Bytes of texts that a part of the shuffled rows should get.
PART_BYTES = 128 << 20
#: Hexadecimal digits of MD5 behind a uniform number: 48 bits.
DIGITS = 12


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the MD5 of the key's parts, joined by colons; nulls count as empty."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long").cast("double") / F.lit(float(16**DIGITS))


def added(numbers: list[Column]) -> Column:
    """Their sum, as a flat tree: a table may have hundreds of columns."""
    while len(numbers) > 1:
        numbers = [a + b for a, b in zip(numbers[::2], numbers[1::2], strict=False)] + numbers[len(numbers) & ~1 :]
    return numbers[0] if numbers else F.lit(0).cast("long")


def shares(documents: DataFrame, targets: dict[str, float] | None, temperature: float) -> DataFrame:
    """(source, n, bytes, weight): rows, bytes of their strings, and target weight of each source; weights are relative.

    Without targets, a source's weight is its share to the power `temperature`. A source
    that targets leave out has weight 0.
    """
    strings = [F.coalesce(F.octet_length(x), F.lit(0)).cast("long") for x, (_, kind) in zip(columns(documents), documents.dtypes, strict=True) if kind == "string"]
    sizes = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(added(strings)).alias("bytes"))
    if targets is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        raw = F.lit(0.0)
        for name, weight in targets.items():
            raw = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(raw)
    return sizes.withColumn("weight", raw)


def copies(documents: DataFrame, targets: dict[str, float] | None = None, rows: int | None = None, temperature: float = 0.5, seed: int = 0) -> DataFrame:
    """documents with rate and copies (may be 0), in their order; `rows` is the wanted sum of copies, as many as documents by default.

    The per-source table has one row a source. Up to BROADCAST_SOURCES rows it is
    broadcast, so a hot source stays where its documents are; beyond that the join is
    left to Spark, whose adaptive join splits hot keys. A null source is a source like
    any other. Columns of documents named like the results are replaced; others may have
    any name. An empty table gives an empty result.
    """
    return _copies(documents, targets, rows, temperature, seed)[0]


def _copies(documents: DataFrame, targets: dict[str, float] | None, rows: int | None, temperature: float, seed: int) -> tuple[DataFrame, float]:
    """(copies() of documents, expected bytes of its copies' strings)."""
    documents = documents.drop("rate", "copies")
    weights = stored(shares(documents, targets, temperature), "weights")
    sums = weights.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources"), F.sum(F.col("weight") / F.col("n") * F.col("bytes")).alias("bytes")).first()
    wanted = float(rows if rows is not None else sums["n"] or 0) / (sums["weight"] or 1.0)
    source, parts, part, most, cdf = free(documents, "mixed_source", "parts", "part", "most", "cdf")
    rated = weights.select(F.col("source").alias(source), (F.col("weight") * F.lit(wanted) / F.col("n")).alias("rate"))
    several = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_RATE)).cast("int")
    rated = rated.withColumns({parts: several, part: F.col("rate") / several})
    # P(count <= j) for j from 0 to far beyond any uniform number below 1
    rated = rated.withColumn(most, F.ceil(F.col(part) + 10 * F.sqrt(part) + 30).cast("int")).withColumn(
        cdf,
        F.expr(f"""transform(aggregate(sequence(1, {most}), array(named_struct('p', exp(-{part}), 'c', exp(-{part}))),
            (s, j) -> concat(s, array(named_struct('p', element_at(s, -1).p * {part} / j, 'c', element_at(s, -1).c + element_at(s, -1).p * {part} / j)))), x -> x.c)"""),
    )
    # a row of the table holds some 80 numbers, so the bound is about 10 MB
    small = F.broadcast(rated) if sums["sources"] <= BROADCAST_SOURCES else rated
    joined = documents.join(small, F.col("source").eqNullSafe(F.col(source)))
    # the numbers are an array first, so that each is hashed once and not for each step of the distribution
    drawn = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda i: uniform(F.lit(seed), F.col("doc_id"), i))
    count = F.aggregate(drawn, F.lit(0), lambda s, u: s + F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    return joined.select(*columns(documents), "rate", count.alias("copies")), wanted * (sums["bytes"] or 0.0)


def mix(documents: DataFrame, targets: dict[str, float] | None = None, rows: int | None = None, temperature: float = 0.5, seed: int = 0) -> DataFrame:
    """Each document as often as its count says, shuffled globally: documents with rate, copy (from 1) and shuffle_key, sorted by shuffle_key.

    The key is a hash of seed, id and copy, so copies of a document part and no range
    of keys is hot. Parts grow in number with the bytes that are mixed. A source without
    weight gives no rows. Repeated rows of one id get the same count each. An empty
    table gives an empty result. Columns of documents named like the results, or copies,
    are replaced; others may have any name.
    """
    documents = documents.drop("copy", "shuffle_key")
    counted, size = _copies(documents, targets, rows, temperature, seed)
    each = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    text = F.concat_ws(":", F.lit(f"shuffle:{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))
    keyed = each.withColumn("shuffle_key", F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long"))
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size // PART_BYTES))
    return keyed.repartitionByRange(parts, "shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")
