"""Documents with the awkward cases that every operator must take."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rng = random.Random(seed)
    return [rng.choice("ab cd Éf gh ij kl mn op qr st uv wx yz été über".split()) + str(rng.randrange(40)) for _ in range(n)]


def texts():
    base = words(1, 300)
    prose = " ".join(base)
    near = " ".join(base[:150] + ["changed"] + base[151:])
    lined = "\n".join(" ".join(words(k, 12)) for k in range(20, 32))
    return [
        (0, prose),
        (1, None),
        (2, ""),
        (3, " \t\n\r\x0b\x0c "),
        (4, prose),
        (5, near),
        (6, " ".join(words(2, 40) + base[100:180] + words(3, 40))),
        (7, lined),
        (8, " ".join(words(4, 30)) + "\n" + lined + "\n\nlast"),
        (9, lined + "\n" + lined),
        (10, "same " * 400),
        (11, "x " + "same " * 300),
        (12, "z" * 1200),
        (13, "y" + "z" * 900),
        (14, "three short words"),
        (15, " ".join(words(5, 60_000))),
        (16, "tie"),
        (16, "tie"),
        (17, "one " + " ".join(words(6, 30))),
        (17, "two " + " ".join(words(7, 30)) + " " + " ".join(base[:40])),
        (18, "ÀÉ straße ñandú 日本語 😀 " * 30),
    ]


def documents(spark, extra=True):
    """With columns whose names operators use inside."""
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in texts()]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        for name in ("id", "key", "n", "w", "names", "row_id", "payloads", "fp", "component", "places", "tie", "n_words", "kept", "domain", "feature", "rate"):
            docs = docs.withColumn(name, F.lit(7))
    return docs
