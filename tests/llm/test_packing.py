import random

from heliovox.llm import packing


def sizes_by_container(rows):
    used = {}
    for r in rows:
        used[r["container"]] = used.get(r["container"], 0) + r["size"]
    return used


def test_every_item_once_and_split_only_if_longer(spark):
    rng = random.Random(3)
    items = [(i, rng.choice([None, -5, 0, 1, 30, 700, 2047, 2048, 2049, 5000, rng.randint(1, 900)]), rng.choice(["a", "a", "b", None])) for i in range(1500)]
    items += items[:40]  # repeated rows are items of their own
    rows = packing.pack(spark.createDataFrame(items, "doc_id long, n_tokens int, source string").selectExpr("*", "1 as container", "2 as piece"), shard_tokens=60_000).collect()
    got, pieces = {}, {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["size"]
        pieces.setdefault(r["doc_id"], []).append(r["size"])
    expected = {}
    for i, n, _ in items:
        if n and n > 0:
            expected[i] = expected.get(i, 0) + n
    assert got == expected
    once = {i: n for i, n, _ in items[40:1500] if n and n > 0}
    for i, n in once.items():
        assert len(pieces[i]) == -(-n // packing.CAPACITY)
    used = sizes_by_container(rows)
    assert max(used.values()) <= packing.CAPACITY
    fewest = -(-sum(used.values()) // packing.CAPACITY)
    assert len(used) <= fewest * 1.03 + 2


def test_mixture_is_kept_in_every_window():
    rng = random.Random(4)
    sizes = [rng.randint(5, 300) for _ in range(6000)]
    sources = [rng.choices("abc", [6, 3, 1])[0] for _ in sizes]
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    sizes, sources = [sizes[i] for i in order], [sources[i] for i in order]
    total = sum(sizes)
    targets = {s: sum(n for n, t in zip(sizes, sources) if t == s) / total for s in "abc"}
    place = packing.fill(sizes, sources, targets, {}, 2048)
    window = 20
    for start in range(0, max(place) - window, window):
        inside = [(n, s) for n, s, c in zip(sizes, sources, place) if start <= c < start + window]
        for s in "abc":
            assert abs(sum(n for n, t in inside if t == s) / sum(n for n, _ in inside) - targets[s]) < 0.03


def test_debt_from_earlier_shards_is_paid_first():
    place = packing.fill([100] * 40, ["a"] * 20 + ["b"] * 20, {"a": 0.5, "b": 0.5}, {"a": -900.0, "b": 900.0}, 1000)
    first = [s for s, c in zip(["a"] * 20 + ["b"] * 20, place) if c == 0]
    assert first.count("b") > first.count("a")


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, n_tokens int, source string")
    assert packing.pack(empty).count() == 0
    assert packing.report(packing.pack(empty)).first()["containers"] == 0


def test_targets_that_are_asked_for(spark):
    rng = random.Random(9)
    items = spark.createDataFrame([(i, rng.randint(5, 300), rng.choice("ab")) for i in range(4000)], "doc_id long, n_tokens int, source string")
    packed = packing.pack(items, targets={"a": 3.0, "b": 1.0}, shard_tokens=10_000_000)
    first = packed.where("container rlike '-[0-9]$'").groupBy("source").sum("size").collect()
    share = {r["source"]: r["sum(size)"] for r in first}
    assert abs(share["a"] / (share["a"] + share["b"]) - 0.75) < 0.05
    assert packed.count() == 4000


def test_pieces_that_fill_a_container_count_towards_the_mixture():
    place = packing.fill([1000] * 10 + [100] * 100, ["a"] * 10 + ["b"] * 100, {"a": 0.5, "b": 0.5}, {}, 1000)
    whole = sorted(place[:10])
    assert all(b - a == 2 for a, b in zip(whole, whole[1:]))


def test_sums_before_shards_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BLOCK", 3)
    shards = spark.createDataFrame([(i, [float(i), -1.0]) for i in range(11)], "shard int, short array<double>")
    got = {r["shard"]: r["behind"] for r in packing._before(shards, ["a", "b"]).collect()}
    assert got == {i: [i * (i - 1) / 2, -float(i)] for i in range(11)}


def test_mixture(spark):
    rows = spark.createDataFrame([("a", 50, "0-0-0"), ("b", 50, "0-0-0"), ("a", 100, "0-0-1"), ("b", 100, "0-0-2"), (None, 100, "0-0-3")], "source string, size int, container string")
    got = {r["window_size"]: r for r in packing.mixture(rows, targets={"a": 1, "b": 1}, windows=(1, 4)).collect()}
    assert got[1]["windows"] == 4 and got[1]["mean_distance"] == (0 + 0.5 + 0.5 + 1) / 4
    assert got[4]["windows"] == 1 and abs(got[4]["mean_distance"] - 0.25) < 1e-9
    assert packing.mixture(rows.limit(0)).count() == 0
