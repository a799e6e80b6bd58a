import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    out = [rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.7 else "") for _ in range(n)]
    return "".join(w + ("\n" if k % 9 == 8 else " ") for k, w in enumerate(out)).strip()


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, repeated and near-repeated texts; null ids and sources."""
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "s0"), (21, base[0].upper(), "en", "s1"), (22, base[1] + " tail", "en", "s2")]
    rows += [(30, None, "en", "s0"), (31, "", None, None), (32, " \n\t ", "en", None), (33, "word", "en", "s1"), (34, "word", "fr", "s1"), (35, "1 2 3 !!", "fr", "s1")]
    rows += [(40, prose(rng, 60_000), "en", "s3"), (None, base[2], "en", "s2"), (None, None, None, None)]
    rows += [(50, base[3], "en", "s0"), (50, base[3], "en", "s0"), (60, "é" * 3000 + " 漢字 🙂", "fr", "s2")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    extra = ("row", "_row", "size", "_size", "score", "shard", "copies", "_hit", "_id", "_th", "_gone", "_src", "rep", "label")
    return df.select("*", *[F.lit(7).alias(c) for c in extra])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
