import io
import json
import zipfile

import numpy as np
import pytest

from neurolith.sources import recordings as rec
from neurolith.sources import sinks, texts

CSV = "time,ch1,ch2,label,subject\n0,1.5,,0,s1\n1,bad,2,rest,s1\n\n2,0.3,0.2,task,s2\n3,0.4\n"


def test_ragged_csv():
    r = rec.read_csv(CSV.encode())
    assert r.channels == ["ch1", "ch2"] and r.bands["raw"].tolist() == [[1.5, 0.0, 0.3, 0.4], [0.0, 2.0, 0.2, 0.0]]
    assert [e[1] for e in r.events] == [0, 1, 2, 0] and r.labels == {0: "0", 1: "rest", 2: "task"}
    assert [e[3] for e in r.events] == ["s1", "s1", "s2", "subject_0"] and r.rate == 1.0  # subjects keep to their rows


def test_csv_dialects_headers_and_rates():
    r = rec.read_csv("0;1\n1;2\n2;4\n".encode())
    assert r.channels == ["col_0", "col_1"] and r.rate == 1.0 and not r.events
    r = rec.read_csv("﻿t\tCH1\n0\t1\n0.5\tnan\n1\t3\n".encode())
    assert r.rate == 2.0 and r.bands["raw"].tolist() == [[1.0, 0.0, 3.0]]
    with pytest.raises(rec.RecordingError):
        rec.read_csv(b"\n \n")
    with pytest.raises(rec.RecordingError):
        rec.read_csv(b"label,subject\na,b\n")


def test_json_turns_tall_matrices_of_every_band():
    p = {"raw_data": [[1, 2], [3, 4], [5, None]], "hbo": [[1, 2], [3, 4], [5, 6]], "sampling_rate": 5, "events": [[1, 0, 7], [2, 0, 8]], "event_id_map": {"7": "go"}, "subject_ids": ["x"]}
    r = rec.read_json(json.dumps(p).replace("null", "NaN").encode())
    assert r.bands["raw"].shape == (2, 3) and r.bands["HbO"].shape == (2, 3) and r.bands["raw"][1, 2] == 0
    assert r.events == [(1, 7, "go", "x"), (2, 8, "8", None)] and r.channels == ["Ch1", "Ch2"]
    with pytest.raises(rec.RecordingError):
        rec.read_json(b'{"raw_data": [[1, 2]], "events": [[1, 2]]}')


def test_nested_variables():
    tree = {"data": {"dataTimeSeries": np.arange(60.0).reshape(20, 3), "time": np.arange(20.0)}, "stim": np.array([[0], [1], [0], [2], [0]]), "fs": np.array([[10]])}
    r = rec.from_tree(tree, "mat")
    assert r.bands["raw"].shape == (3, 20) and r.rate == 10 and [(e[0], e[1]) for e in r.events] == [(1, 1), (3, 2)]
    assert rec.stimulus_events([[0, 0], [1, 0], [0, 1], [0, 0]], 4) == [(1, 1), (2, 2)]


def archive(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, data in members.items():
            z.writestr(n.replace("__", "/").replace("_dot_", "."), data)
    return b.getvalue()


def test_zip_skips_bad_members_and_refuses_paths_that_lead_outside():
    assert rec.read_zip(archive(a_bad_dot_json=b"{", b_good_dot_csv=b"time,ch1,label\n0,1,0\n1,2,1\n")).bands["raw"].shape == (1, 2)
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("../outside.csv", "x")
    with pytest.raises(rec.RecordingError, match="unsafe path"):
        rec.read_zip(b.getvalue())
    with pytest.raises(rec.RecordingError, match="no readable member"):
        rec.read_zip(archive(x_dot_txt=b"1"))


def test_data_source(spark, tmp_path):
    rec.register(spark)
    (tmp_path / "one.csv").write_text(CSV)
    (tmp_path / "two.json").write_text(json.dumps({"raw_data": [[1, 2, 3]]}))
    (tmp_path / "broken.json").write_text("{")
    load = lambda t, **o: spark.read.format("recording").options(table=t, **o).load(str(tmp_path))
    heads = {r.recording_id: r for r in load("recordings", mode="skip").collect()}
    assert set(heads) == {"one", "two"} and heads["one"].n_samples == 4 and heads["one"].event_id_map == {0: "0", 1: "rest", 2: "task"}
    assert load("signals", mode="skip").filter("recording_id = 'one'").count() == 8
    assert [r.label for r in load("events", mode="skip").orderBy("event_idx").collect()] == ["0", "rest", "task", "0"]
    with pytest.raises(Exception, match="JSONDecodeError|Expecting"):
        load("signals").collect()


def test_text_decoding(spark, tmp_path):
    assert texts.decode("近红外光谱数据".encode("gb18030")) == "近红外光谱数据"
    assert texts.decode(b"abc") == "abc" and texts.decode(b"") == "" and texts.decode("ab".encode("utf-16")) == "ab"
    assert texts.repaired("数据".encode().decode("latin-1")) == "数据"
    assert texts.repaired("Ã¼") == "Ã¼" and texts.repaired("Ã¼", need_han=False, gain=0) == "ü"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_bytes("近红外".encode("gb18030"))
    (tmp_path / "b.bin").write_bytes(b"x")
    assert [(r.suffix, r.text) for r in texts.read_texts(spark, str(tmp_path)).collect()] == [(".md", "近红外")]


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "document_id string, ord int, content string")
    sinks.write_index(c, str(tmp_path / "i"))
    sinks.write_index(spark.createDataFrame([("a", 0, "new")], "document_id string, ord int, content string"), str(tmp_path / "i"))
    assert sorted((r.document_id, r.content) for r in spark.read.parquet(str(tmp_path / "i")).collect()) == [("a", "new"), ("b", "y")]
    sinks.write_index(spark.createDataFrame([(f"d{i}", 0, "z") for i in range(40)], "document_id string, ord int, content string"), str(tmp_path / "i"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "i")).count() == 42
    sinks.write_json(spark.createDataFrame([('{"a": 1}',)], "json string"), str(tmp_path / "j"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a": 1}'] and json.loads(sinks.checkpoint_json("tcn", 1))["seed"] == 1
    from neurolith.operators import prototype as pt

    pred = spark.createDataFrame([(1, "f", 0, 0), (2, "g", 1, 0)], "id int, fold string, label int, prediction int")
    r = sinks.result_json(pred, pt.fold_accuracy(pred), pt.confusion(pred))
    assert json.loads(r.collect()[0].json)["accuracy"] == 0.5
    top = spark.createDataFrame([(3, 1.0), (5, 0.5)], "idx int, importance double")
    text = sinks.report(r, top).collect()[0].report
    assert "| f | 1 | 1.0 |" in text and text.index("channel 3") < text.index("channel 5")


def mat5(variables):
    """A MAT file of version 5: numbers, text and structures; every second variable is compressed."""
    import struct
    import zlib

    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    def matrix(name, v):
        head = lambda kind, shape: element(6, struct.pack("<II", kind, 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name.encode())
        if isinstance(v, dict):
            names = b"".join(k.encode().ljust(32, b"\0") for k in v)
            return element(14, head(2, (1, 1)) + struct.pack("<HHi", 5, 4, 32) + element(1, names) + b"".join(matrix("", x) for x in v.values()))
        if isinstance(v, str):
            return element(14, head(4, (1, len(v))) + element(4, np.array(list(map(ord, v)), "<u2").tobytes()))
        a = np.asarray(v)
        kind, code = {"f4": (7, 7), "f8": (6, 9), "i4": (12, 5)}[a.dtype.str[1:]]
        return element(14, head(kind, a.shape) + element(code, a.astype(a.dtype.str.replace(">", "<")).tobytes(order="F")))

    parts = [matrix(k, v) for k, v in variables.items()]
    packed = [p if i % 2 else struct.pack("<II", 15, len(zlib.compress(p))) + zlib.compress(p) for i, p in enumerate(parts)]
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + b"".join(packed)


def test_mat_files():
    signal = np.arange(60, dtype=np.float32).reshape(20, 3)
    raw = mat5({"data": {"dataTimeSeries": signal, "time": np.arange(20.0)}, "note": "a text", "stim": np.array([[0], [1], [0], [2], [0]], np.int32), "fs": np.array([[10.0]])})
    r = rec.parse("x.MAT", raw)
    assert r.bands["raw"].tolist() == signal.T.tolist() and r.rate == 10 and [(e[0], e[1]) for e in r.events] == [(1, 1), (3, 2)]
    with pytest.raises(rec.RecordingError):
        rec.parse("x.nirs", raw[:200])
    with pytest.raises(rec.RecordingError):
        rec.parse("x.mat", b"no")


def test_snirf_layout():
    lists = {f"measurementList{i}": {"sourceIndex": 1, "detectorIndex": i, "wavelengthIndex": 2} for i in (2, 1)}
    nirs = {"data1": {"dataTimeSeries": np.arange(8.0).reshape(4, 2), "time": np.array([1.0, 1.5, 2.0, 2.5]), **lists}, "probe": {"wavelengths": np.array([760.0, 850.0])},
            "stim1": {"name": b"tap", "data": np.array([[2.0, 1, 1]])}, "stim2": {"name": b"rest", "data": np.array([1.0, 1, 1])}}
    r = rec.from_snirf({"formatVersion": b"1.0", "nirs": nirs})
    assert r.channels == ["S1_D1 850", "S1_D2 850"] and r.rate == 2 and r.bands["raw"].shape == (2, 4)
    assert r.events == [(0, 1, "rest", None), (2, 2, "tap", None)] and r.labels == {1: "rest", 2: "tap"}
    with pytest.raises(rec.RecordingError):
        rec.from_snirf({"nirs": {}})


def test_recordings_by_spark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text(CSV)
    (tmp_path / "bad.json").write_text("{")
    got = rec.read_recordings(spark, str(tmp_path), "signals", "skip").orderBy("channel_idx", "t").collect()
    assert [r.v for r in got] == [1.5, 0.0, 0.3, 0.4, 0.0, 2.0, 0.2, 0.0] and got[4].channel == "ch2"
    assert rec.read_recordings(spark, str(tmp_path), "events", "skip").count() == 4
    with pytest.raises(Exception, match="Expecting"):
        rec.read_recordings(spark, str(tmp_path), "recordings").collect()


def docx(*paragraphs):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return b.getvalue()


def pdf():
    import zlib

    page = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\) w\\366rld) Tj 0 -14 Td [(sec) -30 (ond) -300 (line)] TJ ET")
    mapped = b"2 beginbfchar <0001> <8FD1> <0002> <7EA2> endbfchar 1 beginbfrange <0003> <0004> <5916> endbfrange"
    objects = [
        b"<< /Type /Page /Contents 2 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>", b"<< /Filter /FlateDecode >>\nstream\n" + page + b"\nendstream", b"<< /Type /Font >>",
        b"<< /Type /Font /ToUnicode 5 0 R >>", b"<< >>\nstream\n" + mapped + b"\nendstream", b"<< /Type /Page /Contents [7 0 R] >>", b"<< >>\nstream\nBT /F2 9 Tf <000100020003> Tj ET\nendstream",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, start=1))


def test_document_formats(spark, tmp_path):
    assert texts.extract("a.pdf", pdf()) == "Hello (PDF) wörld\nsecond line\n近红外"
    assert texts.extract("a.docx", docx("One.", "Two.")) == "One.\n\nTwo."
    assert texts.extract("a.zip", archive(b_dot_bin=b"x", z_dot_txt=b"late", c_dot_docx=docx("first"))) == "first"
    assert texts.extract("a.doc", b"x") is None and texts.extract("e.md", b"") == ""
    for name, raw in {"p.pdf": pdf(), "d.docx": docx("D"), "broken.pdf": b"x", "z.zip": archive(a_dot_md=b"zipped"), "t.txt": b"t"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error) for r in texts.read_documents(spark, str(tmp_path), str(tmp_path)).collect()}
    assert got["d.docx"] == ("D", None) and got["z.zip"] == ("zipped", None) and got["t.txt"] == ("t", None) and got["p.pdf"][0].startswith("Hello")
    assert got["broken.pdf"] == (None, "DocumentError: no PDF") and len(got) == 5
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("../outside.md", "x")
    with pytest.raises(ValueError, match="unsafe path"):
        texts.extract("a.zip", b.getvalue())


def test_names_are_weighed_by_rules_of_their_own():
    assert texts.repaired_name("报告.md".encode().decode("latin-1")) == "报告.md"
    assert texts.repaired_name("Ã¼ber.md") == "über.md" and texts.repaired_name("plain.md") == "plain.md"


def test_sqlite_tables(spark, tmp_path):
    import sqlite3

    from neurolith.sources import sqlite

    path = str(tmp_path / "meta.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE jobs (id TEXT, progress REAL, n INTEGER, raw BLOB, loose)")
        c.executemany("INSERT INTO jobs VALUES (?, ?, ?, ?, ?)", [(f"j{i}", i / 2, i, b"x", i) for i in range(25)] + [(None, None, None, None, None), ("odd", "text", "7", "y", 1.5)])
        c.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY) WITHOUT ROWID")
        c.execute("INSERT INTO keyed VALUES ('a')")
        c.execute("CREATE TABLE empty (k TEXT)")
    sqlite.register(spark)
    load = lambda t, **o: spark.read.format("sqlite").options(path=path, table=t, **o).load()
    df = load("jobs", rows_per_partition="10")
    assert df.rdd.getNumPartitions() == 3 and df.count() == 27 and dict(df.dtypes) == {"id": "string", "progress": "double", "n": "bigint", "raw": "binary", "loose": "string"}
    odd = df.filter("id = 'odd'").first()
    assert (odd.progress, odd.n, bytes(odd.raw), odd.loose) == (None, 7, b"y", "1.5") and df.filter("id is null").first().n is None
    assert load("keyed").collect()[0].k == "a" and load("empty").count() == 0
    with pytest.raises(Exception, match="no table"):
        load("absent")
