"""Merges: order inside a batch, replays, new and unlisted columns, and which partitions a batch rewrites."""

import os
import uuid

from ringwise.session import checkpoint_dir
from ringwise.sources import io
from ringwise.sources.merge import KeyedTable, fold, merge

SCHEMA = "transaction_id string, amt double, decision string, is_fraud_label boolean, note string, created_at long"
TARGET = [("a", 1.0, "APPROVE", None, "old", 0), ("b", 2.0, "FLAG", True, "old", 0), ("c", None, "FLAG", False, "old", 0)]
# the hand-made batch: several rows a key out of order, null amounts and labels, a tie, a new key, a row without key
UPSERTS = [("a", None, "FLAG", True, "x", 2), ("a", 5.0, "BLOCK", None, "y", 1), ("b", None, "BLOCK", None, "x", 1),
           ("d", None, "APPROVE", False, "second", 2), ("d", 7.0, "FLAG", True, "first", 1),
           ("c", 9.0, "APPROVE", None, "p", 3), ("c", 9.0, "BLOCK", None, "p", 3), (None, 1.0, "FLAG", None, "z", 9)]


def frames(spark):
    return spark.createDataFrame(TARGET, SCHEMA), spark.createDataFrame(UPSERTS, SCHEMA)


def one_by_one(target, batch, replace, fill):
    """The rows applied in order, in plain Python."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    table = {r[0]: dict(zip(names, r)) for r in target}
    rows = [dict(zip(names, r)) for r in batch if r[0] is not None]
    # ties go by the whole row: columns in alphabetical order
    for r in sorted(rows, key=lambda r: (r["created_at"], r["amt"] or 0, r["decision"], str(r["is_fraud_label"]), r["note"])):
        old = table.setdefault(r["transaction_id"], dict(r))
        old.update({c: r[c] for c in replace})
        old.update({c: r[c] for c in fill if r[c] is not None})
    return sorted(tuple(v.values()) for v in table.values())


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_equals_rows_applied_one_by_one_and_a_replay_is_harmless(spark):
    t, b = frames(spark)
    replace, fill = ["decision", "created_at"], ["amt", "is_fraud_label"]
    once = merge(t, b, "transaction_id", ["created_at"], replace, fill)
    assert rows_of(once) == one_by_one(TARGET, UPSERTS, replace, fill)
    assert rows_of(merge(once, b, "transaction_id", ["created_at"], replace, fill)) == rows_of(once)
    got = {r.transaction_id: r for r in once.collect()}
    assert got["d"].note == "first" and got["d"].amt == 7.0 and got["a"].amt == 5.0 and got["a"].note == "old"


def test_true_then_false_is_false(spark):
    t, _ = frames(spark)
    b = spark.createDataFrame([("a", True, 1), ("a", False, 2), ("a", None, 3), ("new", True, 1)],
                              "transaction_id string, is_fraud_label boolean, at long")
    got = {r.transaction_id: r.is_fraud_label for r in io.fill_label(t, b, order="at").collect()}
    assert got == {"a": False, "b": True, "c": False}
    more = io.fill_label(t, b, order="at", insert=True)
    assert {r.transaction_id: (r.is_fraud_label, r.decision) for r in more.collect()}["new"] == (True, None)
    assert {r.transaction_id: r.is_fraud_label for r in io.backfill(t, b, "transaction_id", "is_fraud_label", "at").collect()} == got


def test_insert_absent_takes_the_first_copy(spark):
    t, b = frames(spark)
    got = rows_of(io.insert_absent(t, b, order="created_at"))
    assert got == sorted([*TARGET, ("d", 7.0, "FLAG", True, "first", 1)])


def test_embedding_keeps_its_first_vector(spark):
    schema = "transaction_id string, embedding array<float>, is_fraud boolean"
    t = spark.createDataFrame([("a", [1.0], True)], schema)
    b = spark.createDataFrame([("a", [2.0], None, "APPROVE", 1), ("b", [3.0], None, "APPROVE", 1), ("b", [4.0], None, "BLOCK", 2),
                               ("c", [5.0], True, "APPROVE", 1)],
                              "transaction_id string, embedding array<float>, is_fraud_label boolean, decision string, created_at long")
    assert rows_of(io.upsert_embedding(t, b)) == [("a", [1.0], False), ("b", [3.0], True), ("c", [5.0], True)]


def test_only_touched_partitions_are_rewritten(spark):
    t, b = frames(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/keyed-{uuid.uuid4().hex}"
    many = spark.createDataFrame([(f"k{i}", float(i), "APPROVE", None, "old", 0) for i in range(200)], SCHEMA).unionByName(t)
    table = KeyedTable(spark, path, "transaction_id", 16).create(many)

    def files():
        root = path.removeprefix("file:")
        return {d: sorted(f for f in os.listdir(f"{root}/{d}") if f.endswith(".parquet"))
                for d in os.listdir(root) if d.startswith("_bucket=")}
    before = files()
    replace, fill = ["decision", "created_at"], ["amt", "is_fraud_label"]
    touched = table.merge(b, ["created_at"], replace, fill)
    after = files()
    assert 1 <= len(touched) <= 4
    assert {d for d in after if after[d] != before.get(d)} == {f"_bucket={n}" for n in touched}
    want = merge(many, b, "transaction_id", ["created_at"], replace, fill)
    assert rows_of(table.read().select(*many.columns)) == rows_of(want)
    assert table.merge(b.limit(0), ["created_at"], replace, fill) == []
    assert table.merge(b, ["created_at"], replace, fill) == touched and rows_of(table.read().select(*many.columns)) == rows_of(want)


def test_empty_sides(spark):
    t, b = frames(spark)
    assert rows_of(merge(t, b.limit(0), "transaction_id", ["created_at"], ["decision"])) == sorted(TARGET)
    assert merge(t.limit(0), b, "transaction_id", ["created_at"], ["decision"]).count() == 4
    assert fold(b.limit(0), "transaction_id", ["created_at"]).count() == 0
