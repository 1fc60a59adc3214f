import json

import numpy as np
import pytest

from vectorloom.errors import LoomError
from vectorloom.operators import profile
from vectorloom.sources import deepmd, extxyz, registry

TWO = """2
Lattice="5 0 0 0 5 0 0 0 5" Properties=species:S:1:pos:R:3:forces:R:3 energy=-1.5 pbc="T T F"
Si 0 0 0 0.1 0 0
O1 1.5 0 0 -0.1 0 0

1
plain comment
C 1 2 3
"""


def test_reads_frames_in_both_forms(spark, tmp_path):
    (tmp_path / "a.xyz").write_text(TWO)
    rows = extxyz.read_extxyz(spark, str(tmp_path / "a.xyz")).orderBy("frame_index").collect()
    assert [r["numbers"] for r in rows] == [[14, 8], [6]]
    assert rows[0]["pbc"] == [True, True, False] and rows[0]["energy"] == -1.5
    assert rows[1]["forces"] is None and rows[1]["cell"] == [[0.0] * 3] * 3
    registry.register_formats(spark)
    again = spark.read.format("extxyz").load(str(tmp_path / "a.xyz")).orderBy("frame_index").collect()
    assert [r["positions"] for r in again] == [r["positions"] for r in rows]
    assert registry.detect_format(str(tmp_path / "a.xyz")) == "extxyz"


@pytest.mark.parametrize("text", ["2\nx\nC 0 0 0\n", "x\ny\n", "1\nx\nC 1_0 0 0\n", "1\nx\nQq 0 0 0\n", '1\npbc="T T"\nC 0 0 0\n',
                                  "1\nx\nC nan 0 0\n", "1\nProperties=species:S\nC 0 0 0\n"])
def test_refuses_bad_files(spark, tmp_path, text):
    (tmp_path / "bad.xyz").write_text(text)
    with pytest.raises(Exception, match="INVALID_DATASET"):
        extxyz.read_extxyz(spark, str(tmp_path / "bad.xyz")).collect()


def make_frames(spark, n=25):
    rng = np.random.default_rng(4)
    rows = [(k, f"frame_{k}", [14, 8, 8], rng.normal(size=(3, 3)).tolist(), (np.eye(3) * 9).tolist(), [True] * 3, float(-k), rng.normal(size=(3, 3)).tolist(), None)
            for k in range(n)]
    return spark.createDataFrame(rows, profile.FRAME_SCHEMA)


def test_round_trips(spark, tmp_path):
    frames = make_frames(spark)
    want = np.array([r["positions"] for r in frames.orderBy("frame_index").collect()])
    extxyz.write_extxyz(frames, str(tmp_path / "out"))
    back = extxyz.read_extxyz(spark, str(tmp_path / "out")).orderBy("frame_index").collect()
    np.testing.assert_allclose(np.array([r["positions"] for r in back]), want, atol=1e-8)
    assert [r["energy"] for r in back] == [float(-k) for k in range(25)]
    assert deepmd.write_deepmd(frames, str(tmp_path / "npy")) == 25
    assert registry.detect_format(str(tmp_path / "npy")) == "deepmd"
    other = registry.read_frames(spark, str(tmp_path / "npy")).orderBy("frame_index").collect()
    np.testing.assert_allclose(np.array([r["positions"] for r in other]), want)
    assert [r["energy"] for r in other] == [float(-k) for k in range(25)] and other[0]["pbc"] == [True] * 3


def test_health_of_pathological_frames(spark):
    def frame(k, d, energy=-1.0, forces=None, cell=9.0):
        return (k, f"f{k}", [14, 14], [[0.0, 0.0, 0.0], [d, 0.0, 0.0]], (np.eye(3) * cell).tolist(), [True] * 3, energy,
                forces or [[0.1, 0.0, 0.0], [-0.1, 0.0, 0.0]], None)

    frames = spark.createDataFrame([
        frame(0, 2.3), frame(1, 2.3), frame(2, 2.4, energy=None), frame(3, 2.35, forces=[[80.0, 0.0, 0.0], [0.0, 0.0, 0.0]]),
        frame(4, 2.3, cell=0.0), frame(5, 1.2)], profile.FRAME_SCHEMA)
    checked = profile.health(frames)
    counts = profile.check_counts(checked).first().asDict()
    assert counts == {"missing": 1, "energy_anomaly": 0, "extreme_force": 1, "net_force_violation": 1, "invalid_cell": 1, "nonphysical": 1, "duplicate": 1}
    first = {r["frame_index"]: r["first"] for r in profile.first_occurrences(profile.frame_facts(frames)).collect()}
    assert first[1] == 0 and first[2] == 2
    distances = {r["frame_index"]: r["min_distance"] for r in checked.collect()}
    assert distances[5] == pytest.approx(1.2)


def test_descriptor_files_and_fingerprints(spark, tmp_path):
    frames = make_frames(spark, 4)
    values = np.random.default_rng(0).normal(size=(12, 3))
    np.savez(tmp_path / "d.npz", values=values, metadata=json.dumps({"descriptor": "x", "row_semantics": "atom"}), row_offsets=[0, 3, 6, 9, 12])
    df, meta = registry.import_npz(spark, str(tmp_path / "d.npz"), frames)
    assert df.count() == 12 and df.where("sample_id = 'frame:1:row:2'").count() == 1
    assert registry.export_npz(df, str(tmp_path / "e.npz"), meta) == 12
    with np.load(tmp_path / "e.npz") as pack:
        np.testing.assert_allclose(pack["values"], values)
        assert pack["row_offsets"].tolist() == [0, 3, 6, 9, 12]
    with pytest.raises(LoomError):
        registry.import_npz(spark, str(tmp_path / "d.npz"), make_frames(spark, 5))
    first = registry.source_fingerprint(str(tmp_path))
    (tmp_path / "more").write_text("x")
    assert registry.source_fingerprint(str(tmp_path)) != first
    assert registry.content_fingerprint(df) == registry.content_fingerprint(df.orderBy(df.i.desc()))


TRICKY = """
2
7
Si 0 0 0
O 1 1 1
0
5
0

1
3
C 0 0 0


0
0
3
Properties=species:S:1:pos:R:3
C 0 0 0
H 1 0 0
6 0 1 0

1

C 2 2 2
"""


def test_ranges_find_their_frames_wherever_a_file_is_cut(tmp_path):
    for k, text in enumerate((TRICKY, TRICKY.lstrip(), TRICKY.rstrip(), TRICKY.replace("\n", "\r\n"), "\ufeff" + TRICKY.lstrip(), TWO)):
        path = tmp_path / f"{k}.xyz"
        path.write_bytes(text.encode())
        size = path.stat().st_size
        whole = list(extxyz.frames_between(str(path), 0, size))
        assert [n for _, n, _ in whole] == ([2, 1] if text is TWO else [2, 0, 0, 1, 0, 3, 1])
        for cut in range(1, size):
            assert list(extxyz.frames_between(str(path), 0, cut)) + list(extxyz.frames_between(str(path), cut, size)) == whole, cut
        thirds = [list(extxyz.frames_between(str(path), a, a + 3)) for a in range(0, size, 3)]
        assert [f for part in thirds for f in part] == whole


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    frames = make_frames(spark, 60).orderBy("frame_index")
    texts = [r["value"] for r in extxyz.frame_text(frames).orderBy("frame_index").collect()]
    (tmp_path / "a.xyz").write_text("\n".join(texts[:40]) + "\n")
    (tmp_path / "b.xyz").write_text("\n".join(texts[40:]) + "\n")
    (tmp_path / "c.xyz").write_text("")
    small = (tmp_path / "a.xyz").stat().st_size // 16 + 1
    index = extxyz.index_frames(spark, str(tmp_path), small)
    rows = index.orderBy("frame_index").collect()
    assert [r["frame_index"] for r in rows] == list(range(60)) and [r["local"] for r in rows] == [*range(40), *range(20)]
    one = extxyz.read_extxyz(spark, str(tmp_path), 1 << 30).orderBy("frame_index").collect()
    assert extxyz.read_extxyz(spark, str(tmp_path), small).orderBy("frame_index").collect() == one and len(one) == 60


def test_ranges_that_do_not_meet_are_refused(spark, tmp_path):
    """An atom count beyond the frame runs past the next frame, which another range has found."""
    frame = "2\nx\nC 0 0 0\nC 1 1 1\n"
    text = frame * 3 + frame.replace("2", "5", 1) + frame * 3
    (tmp_path / "a.xyz").write_text(text)
    with pytest.raises(Exception, match="INVALID_DATASET"):
        extxyz.read_extxyz(spark, str(tmp_path / "a.xyz"), 40).collect()
