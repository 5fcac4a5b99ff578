"""Order of lines over files of any sizes."""

import json

import pytest

from wareproof.sources import export
from wareproof.sources.lines import numbered_lines, read_json_lines
from wareproof.sources.records import from_records, read_records


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(line + "\n" for line in lines))


def item(i, title, **more):
    return json.dumps({"id": str(i), "title": title, "tenant": "t", **more})


@pytest.mark.parametrize("block", ["64m", "300b"])
def test_lines_are_numbered_in_the_order_of_files(spark, tmp_path, block):
    files = {"part-0.json": 3, "part-1.json": 200, "part-2.json": 1, "part-3.json": 50}
    want = []
    for name, n in files.items():
        lines = [f"{name} {'x' * (i % 17)} {i}" if i % 5 else "" for i in range(n)]
        write(tmp_path / "in", name, lines)
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        df = numbered_lines(spark, str(tmp_path / "in"))
        got = sorted(tuple(r) for r in df.collect())
        assert block == "64m" or df.rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(want))


@pytest.mark.parametrize("old_first", [True, False])
def test_a_later_file_wins_and_the_first_place_stays(spark, tmp_path, old_first):
    """Whichever of the two files is larger and would be read first."""
    many = [item(100 + i, "filler " + "y" * 50) for i in range(400)]
    first = [item(2, "old"), item(1, "one")] + ([] if old_first else many)
    second = (many if old_first else []) + [item(3, "three"), item(2, "new"), json.dumps({"id": "v", "__parentId": "2", "__typename": "ProductVariant", "tenant": "t"})]
    write(tmp_path / "in", "part-0.json", first)
    write(tmp_path / "in", "part-1.json", second)
    items = export.read_export(spark, str(tmp_path / "in")).items
    rows = {r.id: r for r in items.filter("cast(id as int) < 10").collect()}
    assert rows["2"].title == "new" and rows["2"].n_variants == 1
    assert rows["2"].pos < rows["1"].pos < rows["3"].pos


def test_damaged_and_blank_lines(spark, tmp_path):
    lines = [item(1, "a"), "", "  ", "{broken", "[1, 2]", item(2, "b")]
    write(tmp_path / "in", "part-0.json", lines)
    got = read_json_lines(spark, str(tmp_path / "in"), "id string, title string", "n").orderBy("n").collect()
    assert [(r.n, r.id, r.title) for r in got] == [(0, "1", "a"), (3, None, None), (4, None, None), (5, "2", "b")]


def test_records_take_the_place_of_their_line(spark, tmp_path):
    write(tmp_path / "in", "part-0.json", [json.dumps({"id": "a", "tenant": "t"}), json.dumps({"id": "b", "tenant": "t", "pos": 77})])
    write(tmp_path / "in", "part-1.json", [json.dumps({"id": f"c{i}", "tenant": "t"}) for i in range(300)])
    rows = {r.id: r.pos for r in from_records(read_records(spark, str(tmp_path / "in"))).items.collect()}
    assert rows["a"] == 0 and rows["b"] == 77 and rows["c0"] == 2 and rows["c299"] == 301


def test_no_lines(spark, tmp_path):
    write(tmp_path / "in", "part-0.json", [])
    assert export.read_export(spark, str(tmp_path / "in")).items.collect() == []
