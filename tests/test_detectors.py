"""Detector runners: failures, omissions, repeated images, batches and models."""

import pandas as pd

from photoflow.operators import detectors

IMAGES = "image long, name string"


def rows(spark, keys):
    return spark.createDataFrame([(k, f"n{i}") for i, k in enumerate(keys)], IMAGES).coalesce(1)


def test_every_row_is_accounted_for(spark):
    def fn(batch, config):
        if (batch["image"] == 3).any():
            raise ValueError("broken")
        kept = batch[batch["image"].isna() | ~batch["image"].isin([4, 5])]
        return kept.assign(n=1 << 60)[["image", "n"]].iloc[::-1]

    got = [(r.image, r.n, r.success, r.error) for r in detectors.run_detector(rows(spark, [1, 2, 3, 4, 1, 5, None]), fn, "image long, n long").collect()]
    good = lambda k: (k, 1 << 60, True, None)
    assert got == [good(1), good(2), (3, None, False, "broken"), (4, None, False, "no result"), good(1), (5, None, False, "no result"), good(None)]


def test_repeated_images_keep_their_results():
    b = pd.DataFrame({"image": [1, 1, 2, 1], "v": [10, 20, 30, 40]})
    each = detectors.answers(b, lambda x: x.assign(w=x["v"] + 1)[["image", "w"]], "image", ["w"])
    assert [r["w"] for r, _ in each] == [11, 21, 31, 41]
    once = detectors.answers(b, lambda x: x.drop_duplicates("image").assign(w=x["v"])[["image", "w"]], "image", ["w"])
    assert [r["w"] for r, _ in once] == [10, 10, 30, 10]
    more = detectors.answers(b, lambda x: pd.concat([x, x[x["image"] == 2]]).assign(w=0)[["image", "w"]], "image", ["w"])
    assert [e for _, e in more] == [None, None, "2 results for 1 rows of one image", None]
    two = detectors.answers(b, lambda x: x[x["v"] < 40].assign(w=x["v"])[["image", "w"]], "image", ["w"])
    assert two[3] == (None, "no result")


def test_batches_and_one_model_for_each_worker(spark):
    def make(config):
        import uuid

        return config["start"], uuid.uuid4().hex

    def fn(batch, config, model):
        return batch.assign(n=len(batch), start=model[0], made=model[1])[["image", "n", "start", "made"]]

    d = detectors.Detectors()
    d.register("x", fn, "image long, n long, start long, made string", batch_size=4, model=make, start=1)
    got = d.run("x", rows(spark, range(10)), start=5, other=1).collect()
    assert [r.n for r in got] == [4] * 8 + [2] * 2 and {r.start for r in got} == {5} and len({r.made for r in got}) == 1

    def none(config):
        raise OSError("no weights")

    failed = detectors.run_detector(rows(spark, range(3)), fn, "image long, n long, start long, made string", model=none).collect()
    assert {(r.success, r.error) for r in failed} == {(False, "no model: no weights")}
    assert detectors.run_detector(rows(spark, range(3)).limit(0), fn, "image long, n long, start long, made string", batch_size=2).count() == 0


def test_two_detectors_on_repeated_images(spark):
    def a(batch, config):
        return batch.assign(n=batch["image"] * config["k"])[["image", "n"]]

    def b(batch, config):
        if (batch["image"] == 2).any():
            raise ValueError("dark")
        return batch[batch["image"] != 3].assign(kind=batch["name"])[["image", "kind"]]

    got = detectors.run_two_detectors(rows(spark, [1, 1, 2, 3]), ("a", a, "n long"), ("b", b, "kind string"), config={"k": 7}, batch_size=3).collect()
    assert [(r.image, r.success, r.a.n, r.b and r.b.kind, r.error) for r in got] == [(1, True, 7, "n0", None), (1, True, 7, "n1", None), (2, False, 14, None, "b: dark"), (3, False, 21, None, "b: no result")]


def test_a_half_that_must_fail_is_not_tried_whole():
    asked = []

    def detect(b):
        asked.append(len(b))
        if (b["image"] == 7).any():
            raise ValueError("broken")
        return b.assign(n=b["image"])[["image", "n"]]

    got = detectors.answers(pd.DataFrame({"image": range(8)}), detect, "image", ["n"])
    assert [e for _, e in got] == [None] * 7 + ["broken"] and [r["n"] for r, _ in got[:7]] == list(range(7))
    assert asked == [8, 4, 2, 1, 1]
