"""A growing store, line by line, over batches and byte ranges."""

import pytest

from keyloom.operators import views
from keyloom.sources import tailing
from keyloom.streaming import streams


def batch(spark, path, tmp_path):
    got = []
    q = tailing.tail_lines(spark, path).writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", f"file://{tmp_path}/log").trigger(availableNow=True)
    q = q.start()
    q.awaitTermination()
    return [(r.line, r.ord) for r in sorted(got, key=lambda r: r.ord)]


def test_lines_come_once_in_order_and_a_torn_line_waits(spark, tmp_path):
    store = tmp_path / "store"
    store.mkdir()
    one, two = store / "a", store / "b"
    one.write_bytes(b"1|k|x\n2|k|y\n3|k|to")
    assert batch(spark, str(store), tmp_path) == [("1|k|x", 0), ("2|k|y", 6)]
    assert batch(spark, str(store), tmp_path) == []
    with one.open("ab") as f:
        f.write(b"rn\n\n4|k|\xff\n")
    two.write_bytes("5|k|é\n".encode())
    assert batch(spark, str(store), tmp_path) == [("3|k|torn", 12), ("", 21), ("4|k|�", 22), ("5|k|é", 1 << 40)]


def test_a_single_file(spark, tmp_path):
    (tmp_path / "store.txt").write_text("a\nb\n")
    assert batch(spark, f"file://{tmp_path}/store.txt", tmp_path) == [("a", 0), ("b", 2)]


def test_stores_that_do_not_only_grow_are_refused(spark, tmp_path):
    store = tmp_path / "store"
    store.mkdir()
    (store / "b").write_text("x\n")
    batch(spark, str(store), tmp_path)
    (store / "a").write_text("y\n")
    with pytest.raises(Exception, match="only grows"):
        batch(spark, str(store), tmp_path)


@pytest.mark.parametrize("step", [1, 2, 3, 7, 50])
def test_any_ranges_share_the_lines(tmp_path, monkeypatch, step):
    monkeypatch.setattr(tailing, "BLOCK", 5)
    data = b"".join(b"x" * (i % 9) + b"\n" for i in range(40)) + b"torn"
    (tmp_path / "f").write_bytes(data)
    end = tailing.complete_bytes(*tailing.opened(str(tmp_path / "f")), len(data))
    assert end == len(data) - 4
    for begin in (0, 1, data.index(b"\n", 60) + 1):
        if begin == 1:
            assert data[:1] == b"\n"
        got = [x for at in range(begin, end, step) for x in tailing.lines_of(tailing.Span(str(tmp_path / "f"), 0, begin, at, min(at + step, end), end))]
        assert [line for _, line in got] == data[begin:end].split(b"\n")[:-1]
        assert all(data[at : at + len(line) + 1] == line + b"\n" for at, line in got)


def test_links_keep_their_order_through_the_stream(spark, tmp_path):
    """The first line names the record, though its value sorts last."""
    store = tmp_path / "store"
    store.mkdir()
    (store / "a").write_text("1|2020-01-01|k|zebra\n1|k|ape\n1|k|bear\n")
    lines = streams.run_once(streams.tail(spark, str(store))[0], f"file://{tmp_path}/out", "append")
    assert [(r.value, r.extra) for r in views.first_link(lines).collect()] == [("zebra", 2)]
