import os

from trawl.operators import chunks
from trawl.plans import reviews
from trawl.plans.store import Store


def lines_of(folder):
    return {d: sorted(line for f in os.listdir(os.path.join(folder, d)) if f.startswith("part") for line in open(os.path.join(folder, d, f))) for d in os.listdir(folder) if d.startswith("part=")}


def test_an_interrupted_review_ends_with_the_same_lines(spark, tmp_path):
    texts = [(f"f{k}", "\n".join(f"line {k} {n}" for n in range(30 * k))) for k in range(6)]
    made = reviews.named(chunks.review_chunks(spark.createDataFrame(texts, "file_id string, text string"), most=100)).cache()
    answers = lambda rows: rows.selectExpr("chunk_id", "concat('about ', file_id, ' ', chunk) as answer", "chunk = 3 as failed")
    whole, parts = Store(spark, str(tmp_path / "one")), Store(spark, str(tmp_path / "two"))
    reviews.record(whole, answers(made))
    assert {r.status for r in reviews.manifest(parts, made).collect()} == {"open"} and reviews.pending(parts, made).count() == made.count()
    for keep in ("chunk < 2", "file_id = 'f3'", "true"):
        left = reviews.pending(parts, made)
        reviews.record(parts, answers(left.filter(keep)))
    assert reviews.pending(parts, made).count() == 0
    for name, store in (("a", whole), ("b", parts)):
        reviews.export(store, str(tmp_path / name))
    assert lines_of(tmp_path / "a") == lines_of(tmp_path / "b") and len(lines_of(tmp_path / "a")) > 3
    told = {r.file_id: (r.n_chunks, r.n_done, r.n_failed, r.status) for r in reviews.manifest(parts, made).collect()}
    counts = {r.file_id: r["count"] for r in made.groupBy("file_id").count().collect()}
    assert told == {f: (n, n - (n > 3), int(n > 3), "partial" if n > 3 else "complete") for f, n in counts.items()}
    changed = reviews.named(chunks.review_chunks(spark.createDataFrame([("f1", "new text")], "file_id string, text string"), most=100))
    assert reviews.pending(parts, changed).count() == 1
    made.unpersist()
