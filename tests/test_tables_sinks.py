"""E8 over several formats with corrupt records, S2's bounded batches, Q8's compacted sink."""

import io
import os
import zipfile

import pandas as pd

from conftest import SF001
from quarry.operators.catalog import current_status
from quarry.operators.extract import read_table
from quarry.sources import derived
from quarry.sources.files import _expand
from quarry.streaming import status


def test_e8_keeps_corrupt_records(spark, tmp_path):
    js, cs, xm = tmp_path / "j", tmp_path / "c", tmp_path / "x"
    for d in (js, cs, xm):
        d.mkdir()
    (js / "a.json").write_text('{"id": 1, "name": "a"}\n{"id": 2, "name"\n', encoding="utf-8")
    (js / "b.json").write_text('{"id": 3, "more": 1.5}\n', encoding="utf-8")
    (cs / "a.csv").write_text("id,name\n1,a\n2,b,too many\n", encoding="utf-8")
    (cs / "b.csv").write_text('id,name\n3,"c ""d"""\n', encoding="utf-8")
    (xm / "a.xml").write_text("<rows><row><id>1</id><name>a</name></row></rows>", encoding="utf-8")
    (xm / "b.xml").write_text("<rows><row><id>2</id><name>b &amp; c</name></row></rows>",
                              encoding="utf-8")
    got = {r.id: r for r in read_table(spark, str(js), "json", corrupt="_bad").collect()}
    assert got[1].name == "a" and got[3].more == 1.5 and got[1]._bad is None
    assert got[None]._bad == '{"id": 2, "name"'
    rows = read_table(spark, str(cs), "csv", corrupt="_bad", escape='"').collect()
    assert {(r.id, r.name) for r in rows if r._bad is None} == {(1, "a"), (3, 'c "d"')}
    assert [r._bad for r in rows if r._bad is not None] == ["2,b,too many"]
    rows = read_table(spark, str(xm), "xml", corrupt="_bad").collect()
    assert {(r.id, r.name, r._bad) for r in rows} == {(1, "a", None), (2, "b & c", None)}
    typed = read_table(spark, str(cs), "csv", schema="id STRING, name STRING", escape='"')
    assert dict(typed.dtypes) == {"id": "string", "name": "string"} and typed.count() == 3


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_s2_batches_are_bounded_by_bytes():
    big = _zip([(f"m{i}.txt", b"x" * 1000) for i in range(50)])
    small = [_zip([(f"s{i}.txt", b"y")]) for i in range(20)]
    frame = pd.DataFrame({"path": ["big.zip", "bad.zip", *[f"s{i}.zip" for i in range(20)]],
                          "content": [big, b"no archive", *small]})
    parts = list(_expand(iter([frame]), batch_bytes=10_000))
    assert [len(p) for p in parts[:5]] == [10] * 5 and len(parts) == 6
    rows = pd.concat(parts)
    assert len(rows) == 71 and rows["error"].notna().sum() == 1
    assert set(rows[rows["error"].notna()]["archive_path"]) == {"bad.zip"}
    assert len(list(_expand(iter([frame.iloc[2:]])))) == 1 and not list(_expand(iter([])))


def test_q8_sink_follows_documents(spark, tmp_path):
    ev, src = derived.status_events(spark, SF001), str(tmp_path / "events")
    ev.repartition(7).write.parquet(src)
    cat = derived.catalog(spark, SF001)
    want = sorted(map(tuple, current_status(cat, ev).collect()))
    s = spark.readStream.schema(status.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    sink = str(tmp_path / "sink")
    status.stream_status(s, sink, str(tmp_path / "ck"), compact_every=3)
    view = lambda: sorted(map(tuple, status.status_view(spark, cat, sink).collect()))
    assert view() == want
    # 7 batches: states of batches 2 and 5, changes after batch 2 only
    assert sorted(d for d in os.listdir(f"{sink}/state")) == ["batch_id=2", "batch_id=5"]
    assert min(int(d.split("=")[1]) for d in os.listdir(f"{sink}/changes")) == 3
    state = spark.read.parquet(f"{sink}/state/batch_id=5")
    assert state.count() == state.select("doc_id").distinct().count()
    status.compact(spark, sink, 5)          # again, as after a failure: nothing changes
    assert view() == want
    # a state without its end mark isn't read
    os.remove(f"{sink}/state/batch_id=5/_SUCCESS")
    assert view() == want
