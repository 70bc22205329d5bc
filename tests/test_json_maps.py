import json
import os
import random

import pytest
from pyspark.errors import AnalysisException

from hilandera.sources import json_maps

BITS = ["a", '"', "\\", "\\\\", "{", "}", "[", "]", ",", ":", " ", "ñ", "\n", ', "', '":"', '\\"']


def in_ranges(path, size, step):
    """All entries, range by range, with what each range before makes of the next one's beginning."""
    inside, depth, out = False, 0, []
    for a in range(0, size, step):
        b = min(size, a + step)
        out += json_maps.entries(path, size, a, b, inside, depth)
        ends, by = json_maps.ends(json_maps.read_bytes(path, json_maps._start(path, a, inside), b), inside)
        inside, depth = ends, depth + by
    return out


@pytest.mark.parametrize("step", [1, 2, 3, 7, 16, 64])
def test_entries_in_ranges_of_any_size(tmp_path, monkeypatch, step):
    rng = random.Random(step)
    odd = lambda: "".join(rng.choices(BITS, k=rng.randint(0, 6)))
    for case in range(60):
        monkeypatch.setattr(json_maps, "MORE", rng.choice([1, 5, 100]))
        whole = {f"{i}{odd()}": rng.choice([odd(), rng.random(), [odd(), odd()], {odd(): [odd()], "x": {odd(): 1}}, None, True]) for i in range(rng.randint(0, 12))}
        file = tmp_path / f"{case}.json"
        file.write_text(json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])))
        got = in_ranges(f"file://{file}", os.path.getsize(file), step)
        assert len(got) == len(whole) and {k: json.loads(v) for k, v in got} == whole


def test_one_file_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_maps, "RANGE_BYTES", 500)
    (tmp_path / "m.json").write_text(json.dumps({f"w{i}": {"v": i / 8, "l": [f'"{i}, "']} for i in range(200)}))
    got = json_maps.read_map(spark, f"file://{tmp_path}/m.json", "struct<v:double,l:array<string>>")
    assert {r.k: (r.v.v, r.v.l) for r in got.collect()} == {f"w{i}": (i / 8, [f'"{i}, "']) for i in range(200)}
    assert got.rdd.getNumPartitions() > 5
    with pytest.raises(AnalysisException):
        json_maps.read_map(spark, f"file://{tmp_path}/none.json", "string")
