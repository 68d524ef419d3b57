"""One document written by many tasks."""

import csv
import io
import json
import os
from itertools import groupby

import pytest

from twinlake.operators.groups import LONG
from twinlake.sources import document, sinks


def rows_of(count=40):
    rows = [("content", f"k{g:02}", f"h{g:02}", n, f'/d/{g}/{k:03}"<&>é, x', k) for g, n in enumerate([2, 3, count, 2]) for k in range(n)]
    return rows + [("name", "same", "z", 2, "/n/a\nb", 1), ("name", "same", "z", 2, "/n/c", None)]


def expected_json(rows):
    groups = []
    for key, files in groupby(sorted(rows), key=lambda r: r[:4]):
        groups.append(dict(zip(LONG, key)) | {"files": [{"path": r[4], "size": r[5]} for r in files]})
    text = json.dumps({"group_count": len(groups), "groups": groups}, indent=2, ensure_ascii=False)
    for c in "<>&":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


@pytest.mark.parametrize("parts, piece", [("1", 1 << 20), ("4", 64), ("40", 1)])
def test_many_tasks_write_what_one_would(spark, tmp_path, monkeypatch, parts, piece):
    """Groups that begin, end or lie in the middle of parts, parts without rows, pieces of a byte."""
    rows = rows_of()
    frame = spark.createDataFrame(rows, "match_type string, match_key string, hash string, duplicate_count long, path string, size_bytes long").repartition(3)
    monkeypatch.setattr(document, "WRITE", piece)
    monkeypatch.setattr(document, "cut", lambda df: df.repartitionByRange(int(parts), *document.ORDER).sortWithinPartitions(*document.ORDER).checkpoint())
    from twinlake.checkpoints import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    sinks.write_json(frame, str(tmp_path / "o.json"))
    assert (tmp_path / "o.json").read_text() == expected_json(rows)
    sinks.write_csv(frame, str(tmp_path / "o.csv"))
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([LONG, *sorted(rows, key=lambda r: r[:5])])
    assert (tmp_path / "o.csv").read_text() == out.getvalue()
    plain = frame.where("path not like '/n/%'")
    for bullets in (False, True):
        sinks.write_text(plain, str(tmp_path / "o.txt"), bullets)
        want = ""
        for key, files in groupby(sorted(r for r in rows if r[0] == "content"), key=lambda r: r[:4]):
            want += f"Hash: {key[1]}\n" + "".join(f"  - {r[4]}\n" if bullets else f" {k}: {r[4]}\n" for k, r in enumerate(files, 1))
        assert (tmp_path / "o.txt").read_text() == want == "\n".join(sinks.text_lines(plain, bullets)) + "\n"
    assert os.stat(tmp_path / "o.json").st_mode & 0o777 == 0o600 and sorted(os.listdir(tmp_path)) == ["o.csv", "o.json", "o.txt"]


def test_a_document_that_cannot_be_written_leaves_the_old_one(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame(rows_of(3), "match_type string, match_key string, hash string, duplicate_count long, path string, size_bytes long")
    (tmp_path / "o").write_text("old")
    with pytest.raises(ValueError, match="not a file"):
        sinks.write_csv(frame, str(tmp_path))
    with pytest.raises(ValueError, match="not a file"):
        sinks.write_csv(frame, "")

    def failing(row, before):
        if os.path.exists(tmp_path / "fail"):
            raise ValueError("a task fails")
        return "x"

    assert document.write_document(frame, str(tmp_path / "o"), failing, lambda n: f"{n}:", lambda n: ".") == (tmp_path / "o").stat().st_size
    assert (tmp_path / "o").read_text() == "5:" + "x" * 12 + "."
    (tmp_path / "fail").write_text("")
    with pytest.raises(Exception, match="a task fails"):
        document.write_document(frame, str(tmp_path / "o"), failing, lambda n: "", lambda n: "")
    monkeypatch.setattr(document.os, "replace", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    (tmp_path / "fail").unlink()
    with pytest.raises(OSError, match="stopped"):
        document.write_document(frame, str(tmp_path / "o"), failing, lambda n: "", lambda n: "")
    assert (tmp_path / "o").read_text() == "5:" + "x" * 12 + "." and os.listdir(tmp_path) == ["o"]
