import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (doc_id, text); `clash` adds columns with names that operators use themselves."""

    def make(rows, clash=True):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        out = spark.createDataFrame([(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows], SCHEMA)
        names = ("size", "shard", "score", "bands", "class_id", "key", "spans", "start", "first", "core", "label", "pii", "row", "id", "k1", "k2", "f1", "f2", "repeated", "_id", "_k1", "_k2", "_f1", "_f2", "_repeated", "fp", "part", "fails", "salt") if clash else ()
        return out.withColumns({n: F.lit("clash") for n in names})

    return make


VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def prose():
    def say(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(VOCABULARY) + str(r.randrange(40)) for _ in range(n))

    return say
