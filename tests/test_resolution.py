"""Names in questions: longest matches, visibility, narrowing."""

from evigrid.operators import resolution

NAMES = "label string, entity string, domains array<string>, groups array<string>, ord long"
QUESTIONS = "question long, groups array<string>, text string, scope string"


def test_resolved(spark):
    names = [
        ("quote service", "fx-quote", ["fx"], ["a", "b"], 2),
        ("quote service", "pay-quote", ["payments"], ["a"], 1),
        ("quote", "old-quote", ["fx"], ["b"], 3),
        ("service desk line two", "desk", ["ops"], ["a"], 4),
        ("secret name", "hidden", ["fx"], ["c"], 5),
        ("orphan", "nobody", ["fx"], None, 6),
    ]
    questions = [
        (1, ["a"], "Does the quote service answer?", None),
        (2, ["a"], "Does the quote service of payments answer?", None),
        (3, ["a"], "quote service", "FX"),
        (4, ["b"], "quote service, quote", "payments"),
        (5, ["a"], "quote service desk line two", "fx payments"),
        (6, ["a"], "secret name and orphan", None),
        (7, [], "quote", None),
        (8, ["a"], None, None),
        (9, ["a"], "service desk line", "ops"),
    ]
    got = resolution.resolved(spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(names, NAMES)).collect()
    assert sorted((r["question"], r["pos"], r["label"], tuple(r["candidates"]), tuple(r["chosen"]), r["origin"]) for r in got) == [
        (1, 3, "quote service", ("fx-quote", "pay-quote"), ("fx-quote", "pay-quote"), "denotes"),
        (2, 3, "quote service", ("fx-quote", "pay-quote"), ("pay-quote",), "request_context"),
        (3, 1, "quote service", ("fx-quote", "pay-quote"), ("fx-quote",), "request_context"),
        (4, 1, "quote service", ("fx-quote",), ("fx-quote",), "denotes"),
        (4, 3, "quote", ("old-quote",), ("old-quote",), "denotes"),
        (5, 1, "quote service", ("fx-quote", "pay-quote"), ("fx-quote", "pay-quote"), "denotes"),
        (6, 1, "secret name", (), (), "none"),
        (6, 4, "orphan", (), (), "none"),
        (7, 1, "quote", (), (), "none"),
    ]
    first = resolution.label_only(resolution.matched_labels(spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(names, NAMES)), spark.createDataFrame(names, NAMES))
    assert {(r["question"], r["entity"]) for r in first.collect() if r["question"] in (1, 4)} == {(1, "pay-quote"), (4, "pay-quote"), (4, "old-quote")}
