import io
import struct
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from lodemill.operators import media
from lodemill.sources import files as sources


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", w, h, 8, 6, 0, 0, 0)


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, h, w) + b"\0" * 20


def wav(seconds):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0\0" * int(8000 * seconds))
    return out.getvalue()


def office(member):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<a/>")
        z.writestr(member, "<a/>")
    return out.getvalue()


def test_descriptions(spark):
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9)
    pdf = b"%PDF-1.7 /Type /Pages /Type /Page x /Type/Page /Encrypt"
    rows = [("a.png", png(640, 480)), ("b.jpg", jpeg(32, 16)), ("c.gif", b"GIF89a" + struct.pack("<HH", 5, 6)), ("d.bmp", bmp), ("e.wav", wav(1.5)), ("f.docx", office("word/x.xml")), ("g.xlsx", office("word/x.xml")), ("h.pdf", pdf), ("i.mov", b"\0\0\0\x14ftypqt  "), ("j.m4a", b"\0\0\0\x14ftypM4A "), ("k.mp4", b"\0\0\0\x14ftypisom"), ("l.txt", b"plain"), ("m", b""), ("n", None), ("o.zip", b"PK\x03\x04broken")]
    got = {r.path: r for r in media.describe(spark.createDataFrame(rows, "path string, content binary")).collect()}
    size = lambda p: (got[p].width, got[p].height)
    assert (size("a.png"), size("b.jpg"), size("c.gif"), size("d.bmp")) == ((640, 480), (32, 16), (5, 6), (7, 9))
    assert got["e.wav"].duration_ms == 1500 and got["h.pdf"].pages == 2 and got["h.pdf"].encrypted
    assert got["f.docx"].media_type == media.OFFICE["word/"] and not got["f.docx"].mismatch and got["g.xlsx"].mismatch
    assert [got[p].media_type for p in ("i.mov", "j.m4a", "k.mp4", "l.txt", "m", "n", "o.zip")] == ["video/quicktime", "audio/mp4", "video/mp4", None, None, None, "application/zip"]


def test_headers_that_lie():
    data = bytearray(wav(1.0))
    data[40:44] = struct.pack("<I", 2**31)
    assert media.wav_report(bytes(data))[3] == 1000
    assert media.wav_report(b"RIFF") is None and media.jpeg_size(b"\xff\xd8\xff") is None
    assert media.zip_report(b"no zip") == (None, False)


def test_reports(spark):
    probe = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"avg_frame_rate":"30/1","r_frame_rate":"30/1"}],"format":{"duration":"10.5"}}'
    df = spark.createDataFrame([(probe,), ("{}",), ("bad",), (probe.replace("30/1", "0/0", 1),)], "j string").select(media.probe_report(F.col("j")).alias("r"))
    r = [x.r for x in df.collect()]
    assert r[0].asDict() == {"codec": "h264", "width": 1920, "height": 1080, "duration_ms": 10500, "frame_rate": 30.0, "variable_rate": False, "has_audio": True}
    assert r[1] is None and r[2] is None and r[3].frame_rate is None
    times = spark.createDataFrame([("pts_time:1.5 x pts_time:0.25\npts_time:1.5 pts_time:bad",), (None,)], "t string").select(media.scene_times(F.col("t")).alias("x"))
    assert [x.x for x in times.collect()] == [[250, 1500], None]


def test_pages_and_text(spark):
    pages = spark.createDataFrame([("a", 2, 1, "x" * 300), ("a", 2, 2, "x" * 300), ("b", 5, 1, "x" * 300), ("c", 1, 1, None)], "id string, page_count int, page int, text string")
    assert {r.id: r.sufficient for r in media.is_sufficient(pages).collect()} == {"a": True, "b": False, "c": False}
    html = "<html><head><title>t</title><script>x()</script></head><body><h1>Head&amp;line</h1><p>One <b>two</b></p></body></html>"
    rows = [("p.html", html.encode()), ("t.md", "# Ä".encode()), ("b", b"\0\1"), ("n", None)]
    assert {r.path: r.text for r in media.extract_text(spark.createDataFrame(rows, "path string, content binary")).collect()} == {"p.html": "Head&line\nOne two", "t.md": "# Ä", "b": "", "n": ""}
    df = spark.createDataFrame([("abcd", "abxd"), (None, "a"), ("", "")], "a string, b string").select(media.overlap_ratio(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in df.collect()] == [pytest.approx(0.75), None, 1.0]


def test_folder_scan(spark, tmp_path):
    (tmp_path / "a/.git").mkdir(parents=True)
    for name, text in (("a/x.md", "hello"), ("a/.git/y.md", "no"), ("a/z.bin", "no"), ("b.py", "1"), ("c.py", "")):
        (tmp_path / name).write_text(text)
    rows = sources.scan(spark, str(tmp_path)).collect()
    assert sorted((r.name, r.suffix, r.size_bytes) for r in rows) == [("b.py", ".py", 1), ("x.md", ".md", 5)]
    assert sources.scan(spark, str(tmp_path / "missing"), content=False).count() == 0
    (tmp_path / "r.json").write_text('{"1": {"id": "1", "path": "/a", "size_bytes": 3}, "2": {"path": "/b"}, "3": {"id": "3", "path": "/c"}}')
    old = spark.createDataFrame([("3",)], "id string")
    assert [r.id for r in sources.legacy_records(spark, str(tmp_path / "r.json"), old).collect()] == ["1"]
    import sqlite3

    with sqlite3.connect(tmp_path / "w.db") as db:
        db.execute("create table t (a int, b text)")
        db.executemany("insert into t values (?, ?)", [(1, "x"), (2, None)])
    got = sources.sqlite_rows(spark, str(tmp_path / "w.db"), "select a, b from t", "a bigint, b string").collect()
    assert [tuple(r) for r in got] == [(1, "x"), (2, None)]
