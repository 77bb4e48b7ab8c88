"""JSON documents in parts: written by many tasks, read by many tasks, whole or not at all."""

from __future__ import annotations

import json
import os
import random
from pathlib import Path

import pytest
from forecourt.sources import documents, listings, sinks
from forecourt.sources.documents import items, pieces, surroundings, write_document
from pyspark.sql import functions as F

CAR = {"dealer_name": "D", "dealer_website": "https://d", "vehicle_url": "https://d/1", "year": 2024, "make": "Kia", "model": "EV6", "new_used": "new"}


@pytest.fixture
def small_splits(spark):
    settings = {"maxPartitionBytes": None, "openCostInBytes": 0, "minPartitionNum": 1}

    def use(size):
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.files.{k}", size if v is None else v)

    yield use
    for k in settings:
        spark.conf.unset(f"spark.sql.files.{k}")


def nasty(r, depth=0):
    """Any JSON value, with brackets, quotes and escapes in its strings."""
    kind = r.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return "".join(r.choice('ab{}[]"\\,:\n é\U0001f600') for _ in range(r.choice([0, 3, 40])))
    if kind < 4:
        return r.choice([None, True, 12, -1.5])
    if kind < 6:
        return {f"k{i}" + r.choice(["", "}", '"cars"', "{"]): nasty(r, depth + 1) for i in range(r.randrange(4))}
    return [nasty(r, depth + 1) for _ in range(r.randrange(4))]


@pytest.mark.parametrize(("size", "indent"), [(7, None), (200, 2), (1 << 27, None)])
def test_objects_of_any_document(spark, tmp_path, small_splits, size, indent):
    small_splits(size)
    r = random.Random(size)
    wanted, around = {}, {}
    for n in range(1 if size == 7 else 4):
        cars = [{"i": i, "x": nasty(r)} for i in range(r.choice([0, 1, 12 if size > 7 else 3]))]
        document = {"metadata": {"cars": [{"no": 1}], "x": nasty(r)}, "cars": cars, "after": [{"z": nasty(r)}], "cars2": nasty(r)}
        text = json.dumps(document, indent=indent, ensure_ascii=bool(n % 2)) + "\n" * (n % 3)
        (tmp_path / f"{n}.json").write_text(text)
        wanted[n], around[n] = cars, document | {"cars": []}
    found = pieces(spark, str(tmp_path), "cars")
    name = lambda document: int(Path(document).stem)
    got = {n: [] for n in wanted}
    for row in items(found).collect():
        got[name(row.document)].append(json.loads(row.text))
    assert {n: sorted(cars, key=lambda c: c["i"]) for n, cars in got.items()} == wanted
    assert {name(row.document): json.loads(row.text) | {"cars": []} for row in surroundings(found).collect()} == around
    assert documents.damaged(found).count() == 0


def test_damage_anywhere_is_seen(spark, tmp_path, small_splits):
    small_splits(75)
    good = json.dumps({"cars": [{"a": "x}{"}, {"a": {"b": [1]}}, {"a": 3}], "n": 1}, indent=1)
    bad = [good[:-1], good[:-4], good[: len(good) // 2], good + "}", good.replace(" 3", " 3,"), good.replace('"n"', "n"), good.replace('{"a": 3'[:1], "", 1), good.replace("},", "}", 1), good.replace("},", "},,", 1), good[:-30] + "]", "{", '{"cars": [{"a": "unclosed']
    for n, text in enumerate(bad):
        (tmp_path / f"{n}.json").write_text(text)
    (tmp_path / "good.json").write_text(good)
    got = {Path(r.document).stem for r in documents.damaged(pieces(spark, str(tmp_path), "cars")).collect()}
    want = {str(n) for n in range(len(bad))}
    assert got == want


def test_one_document_of_many_parts(spark, tmp_path):
    path = str(tmp_path / "cars.json")
    rows = spark.range(1000, numPartitions=40).where("id < 300 or id > 700").select(F.to_json(F.struct("id", F.lit("a}\n\"{").alias("t"))))
    write_document(rows, path, lambda n: f'{{"n":{n},"cars":[\n', "]}\n")
    folder = next(p for p in Path(path).iterdir() if p.name.startswith(documents.DOCUMENT))
    whole = json.loads(b"".join(p.read_bytes() for p in sorted(folder.iterdir()) if not p.name.startswith(".")))
    assert whole["n"] == len(whole["cars"]) == 599 and [c["id"] for c in whole["cars"]] == [i for i in range(1000) if i < 300 or i > 700]
    documents.merge_document(spark, path, str(tmp_path / "one.json"))
    assert json.loads((tmp_path / "one.json").read_text()) == whole
    found = pieces(spark, path, "cars")
    assert items(found).count() == 599 and documents.damaged(found).count() == 0
    write_document(rows.limit(0), path, lambda n: f'{{"n":{n},"cars":[', "]}", mode="append")
    assert items(pieces(spark, path, "cars")).count() == 599 and surroundings(pieces(spark, path, "cars")).count() == 2
    write_document(rows.repartition(3), path, lambda n: '{"cars":[', "]}", pretty=False)
    assert items(pieces(spark, path, "cars")).count() == 599 and surroundings(pieces(spark, path, "cars")).count() == 1


def test_several_files_of_a_task(spark, tmp_path):
    path = str(tmp_path / "cars.json")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        write_document(spark.range(50, numPartitions=3).select(F.to_json(F.struct("id"))), path, lambda n: '{"cars":[', "]}")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    documents.merge_document(spark, path, str(tmp_path / "one.json"))
    assert [c["id"] for c in json.loads((tmp_path / "one.json").read_text())["cars"]] == list(range(50))


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "cars.json")
    good = spark.range(5).select(F.to_json(F.struct("id")))
    write_document(good, path, lambda n: '{"cars":[', "]}")
    failing = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise("x"))
    with pytest.raises(Exception, match="stop"):
        write_document(failing, path, lambda n: '{"cars":[', "]}")
    assert items(pieces(spark, path, "cars")).count() == 5 and len([p for p in os.listdir(path) if not p.startswith(".")]) == 1
    with pytest.raises(ZeroDivisionError):
        write_document(good, path, lambda n: str(n // 0), "]}")
    assert items(pieces(spark, path, "cars")).count() == 5 and len([p for p in os.listdir(path) if not p.startswith(".")]) == 1


def test_a_file_is_replaced_by_a_document(spark, tmp_path):
    path = tmp_path / "cars.json"
    path.write_text('{"cars": [{"id": 9}]}')
    rows = spark.range(2).select(F.to_json(F.struct("id")))
    with pytest.raises(ValueError, match="is a file"):
        write_document(rows, str(path), lambda n: '{"cars":[', "]}", mode="append")
    write_document(rows, str(path), lambda n: '{"cars":[', "]}")
    assert items(pieces(spark, str(path), "cars")).count() == 2


def test_listings_of_documents(spark, tmp_path, small_splits):
    small_splits(900)
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {}, "cars": [CAR | {"vehicle_url": f"https://d/{i}", "unknown": {"a": [1]}} for i in range(20)]}, indent=2))
    (tmp_path / "none.json").write_text('{"metadata": {"total": 0}}')
    cars = listings.read_json(spark, str(tmp_path), as_of_year=2024)
    assert sorted(r.vehicle_url for r in cars.collect()) == sorted(f"https://d/{i}" for i in range(20))
    out = str(tmp_path / "out.json")
    sinks.write_json(cars, out, "2024-01-01T00:00:00")
    assert listings.read_json(spark, out, as_of_year=2024).exceptAll(cars).count() == 0 and sinks.count_saved(spark, out, "json") == 20
    (tmp_path / "bad.json").write_text('{"cars": [')
    with pytest.raises(Exception, match="no JSON"):
        listings.read_json(spark, str(tmp_path / "bad.json"), as_of_year=2024).count()


def test_damaged_state_is_no_state(spark, tmp_path, small_splits):
    small_splits(400)
    state = json.dumps({"completed_dealerships": ["A", "B}"], "scraped_listings": [CAR] * 6, "version": "1"}, indent=2)
    (tmp_path / "good.json").write_text(state)
    cars, done = listings.read_state(spark, str(tmp_path / "good.json"))
    assert cars.count() == 6 and sorted(r.name for r in done.collect()) == ["A", "B}"]
    for n in (1, 200):
        (tmp_path / "bad.json").write_text(state[:-n])
        cars, done = listings.read_state(spark, str(tmp_path / "bad.json"))
        assert cars.count() == done.count() == 0


def test_compressed_documents(spark, tmp_path):
    import gzip

    for n, end in enumerate(("", "\n", "  \n\n")):
        (tmp_path / f"{n}.json.gz").write_bytes(gzip.compress((json.dumps({"cars": [CAR | {"vehicle_url": f"https://d/{n}/{i}", "model": "x" * 500} for i in range(9)]}) + end).encode()))
    assert listings.read_json(spark, str(tmp_path), as_of_year=2024).count() == 27
