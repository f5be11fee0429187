"""Small tables for the pipeline's tests."""

import random

SF = "/root/testdata/sf0.001"


def write_platform(spark, path):
    rng = random.Random(12)
    words = [f"term{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, "\n".join(text(12) for _ in range(4)), rng.choice(["en", "de"]), f"src{rng.randrange(20)}") for i in range(100)]
    base = text(150).split()
    for i in range(100, 110):
        w = list(base)
        w[rng.randrange(len(w))] = f"other{i}"
        rows.append((i, " ".join(w), "en", "src0"))
    shared = "\n".join(f"shared passage line {k} {text(6)}" for k in range(12))
    rows += [(i, f"{text(9)}\n{shared}\n{text(9)}", "en", "src0") for i in range(110, 130)]
    rows += [(i, text(60), "fr", "src4") for i in range(130, 200)]
    rows += [(i, text(20) + " vile scum filth " + text(20), "en", "src5") for i in range(200, 220)]
    rows += [(i, text(40) + (" vile scum filth" if i % 2 else ""), "en", "src6") for i in range(220, 420) if i % 2 or i < 260]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(200 <= i < 220 or i >= 220 and i % 2 == 1)) for i, *_ in rows if i % 7]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
