"""Archives as streams and fetching by ranges."""

import hashlib
import io
import random
import tarfile
import tracemalloc

import pytest

from lodestack.sources import archives as A
from lodestack.sources import fetch as S
from lodestack.sources import files as sources


def tar(path, entries, **k):
    with tarfile.open(path, "w:gz", **k) as out:
        for name, content in entries:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            out.addfile(info, io.BytesIO(content))
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        out.addfile(folder)
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "folder"
        out.addfile(link)
        info = tarfile.TarInfo("last")
        info.size = 3
        out.addfile(info, io.BytesIO(b"end"))


ENTRIES = [("a/x.txt", b"one"), ("empty", b""), ("block", b"b" * 512), ("large.bin", random.Random(1).randbytes(70_000)), ("deep/" * 40 + "long name é.txt", b"named"), ("deep/" * 24 + "split.txt", b"prefix")]


@pytest.mark.parametrize("kind", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT, tarfile.USTAR_FORMAT])
def test_archives_in_chunks(spark, tmp_path, kind):
    entries = [e for e in ENTRIES if kind != tarfile.USTAR_FORMAT or len(e[0]) < 150]
    tar(tmp_path / "one.tar.gz", entries, format=kind)
    tar(tmp_path / "two.tar.gz", [], format=kind)
    spark.dataSource.register(A.ArchiveSource)
    frame = spark.read.format("archive").option("chunkBytes", 1000).load(f"{tmp_path}/*.tar.gz")
    assert frame.rdd.getNumPartitions() == 2
    found = {}
    for r in sorted(frame.collect(), key=lambda r: r.chunk):
        assert len(r.content) <= 1000
        found[r.archive[-10:-7], r.member] = found.get((r.archive[-10:-7], r.member), b"") + bytes(r.content)
    assert found == {("one", n): c for n, c in [*entries, ("last", b"end")]} | {("two", "last"): b"end"}
    whole = {(r.member, r.size, bytes(r.content)) for r in sources.read_archive_members(spark, f"{tmp_path}/one.tar.gz").collect()}
    assert whole == {(n, len(c), c) for n, c in [*entries, ("last", b"end")]}


def test_a_large_archive_takes_no_more_memory(tmp_path):
    class Zeros(io.RawIOBase):
        def readable(self):
            return True

        def readinto(self, b):
            b[:] = bytes(len(b))
            return len(b)

    with tarfile.open(tmp_path / "big.tar.gz", "w:gz", compresslevel=1) as out:
        info = tarfile.TarInfo("big")
        info.size = 300 << 20
        out.addfile(info, io.BufferedReader(Zeros()))
    with open(tmp_path / "big.tar.gz", "rb") as file:
        tracemalloc.start()
        n = sum(len(data) for *_, data in A.members(file, 1 << 20))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert n == 300 << 20 and most < 12 << 20


def test_broken_archives(tmp_path):
    tar(tmp_path / "one.tar.gz", ENTRIES)
    data = (tmp_path / "one.tar.gz").read_bytes()
    with pytest.raises(EOFError):
        list(A.members(io.BytesIO(data[: len(data) // 2]), 1000))
    with pytest.raises(ValueError):
        list(A.members(io.BytesIO(__import__("gzip").compress(b"x" * 1024)), 1000))


def test_extracted_archives(spark, tmp_path):
    tar(tmp_path / "one.tar.gz", ENTRIES)
    rows = A.extract_archives(spark, f"{tmp_path}/one.tar.gz", f"{tmp_path}/out", chunk=999).collect()
    assert {r.member: (tmp_path / "out" / "one" / r.member).read_bytes() for r in rows} == dict([*ENTRIES, ("last", b"end")])
    assert not list((tmp_path / "out").rglob("*.part"))
    tar(tmp_path / "bad.tar.gz", [("../../up", b"x")])
    with pytest.raises(Exception, match="leads out"):
        A.extract_archives(spark, f"{tmp_path}/bad.tar.gz", f"{tmp_path}/out").collect()


def cut(log, beyond=None):
    """An opener that fails beyond a place, and notes which ranges were asked for."""
    log, read = str(log), S.read_range

    def opened(url, start, stop):
        with open(log, "a") as f:
            f.write(f"{url.rsplit('/', 1)[-1]} {start}\n")
        if beyond is not None and start >= beyond:
            yield b"x"
            raise ConnectionError("cut short")
        yield from read(url, start, stop)

    return opened


def test_a_fetch_that_is_cut_short_goes_on(spark, tmp_path):
    draw = random.Random(2)
    rows = []
    for name, n in (("a.bin", 10_500), ("b.bin", 3_000), ("sub/c.bin", 1), ("none.bin", 0)):
        data = draw.randbytes(n)
        (tmp_path / "from" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "from" / name).write_bytes(data)
        rows.append((name, f"file://{tmp_path}/from/{name}", n, hashlib.md5(data).hexdigest()))
    rows.append(("wrong.bin", f"file://{tmp_path}/from/b.bin", 3_000, "0" * 32))
    wanted, to = spark.createDataFrame(rows, "name string, url string, size long, md5 string"), str(tmp_path / "to")
    first = {r.name: (r.ok, r.error) for r in S.fetch(wanted, to, 1_000, cut(tmp_path / "log", 4_000)).collect()}
    assert first["b.bin"] == first["sub/c.bin"] == first["none.bin"] == (True, None)
    assert first["a.bin"] == (False, "4000 of 10500 bytes are there") and "MD5" in first["wrong.bin"][1]
    assert not (tmp_path / "to" / "a.bin").exists() and not (tmp_path / "to" / "wrong.bin").exists()
    (tmp_path / "log").write_text("")
    again = {r.name: r.ok for r in S.fetch(wanted.filter("name != 'wrong.bin'"), to, 1_000, cut(tmp_path / "log")).collect()}
    assert again == {"a.bin": True, "b.bin": True, "sub/c.bin": True, "none.bin": True}
    asked = sorted(line.split() for line in (tmp_path / "log").read_text().splitlines())
    assert asked == sorted(["a.bin", str(k)] for k in range(4_000, 10_500, 1_000))  # only the rest
    for name, *_ in rows[:4]:
        assert (tmp_path / "to" / name).read_bytes() == (tmp_path / "from" / name).read_bytes()
    (tmp_path / "to" / "b.bin").write_bytes(b"damaged")
    assert {r.ok for r in S.fetch(wanted.filter("name = 'b.bin'"), to, 1_000).collect()} == {True}
    assert (tmp_path / "to" / "b.bin").read_bytes() == (tmp_path / "from" / "b.bin").read_bytes()
