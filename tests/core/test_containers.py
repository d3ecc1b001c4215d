"""7z archives and PDF files, made here byte by byte."""

import bz2
import lzma
import random
import struct
import zlib

import pytest

from trawl.sources import extract, pdf, sevenzip


def number(n):
    for more in range(8):
        if n < 1 << 7 + 7 * more:
            return bytes([(0xFF00 >> more & 0xFF) | n >> 8 * more]) + (n & (1 << 8 * more) - 1).to_bytes(more, "little")
    return b"\xff" + n.to_bytes(8, "little")


LZMA1 = (b"\x03\x01\x01", struct.pack("<BI", 93, 1 << 20))
LZMA2 = (b"\x21", bytes([16]))
FILTERS = {b"\x03\x01\x01": {"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20, "lc": 3, "lp": 0, "pb": 2}, b"\x21": {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}, b"\x03\x03\x01\x03": {"id": lzma.FILTER_X86}, b"\x03": {"id": lzma.FILTER_DELTA, "dist": 4}}


def packed(body, coders):
    names = [c[0] for c in coders]
    if names == [b"\x00"]:
        return body
    if names == [b"\x04\x01\x08"]:
        made = zlib.compressobj(9, zlib.DEFLATED, -15)
        return made.compress(body) + made.flush()
    if names == [b"\x04\x02\x02"]:
        return bz2.compress(body)
    return lzma.compress(body, lzma.FORMAT_RAW, filters=[FILTERS[n] for n in names])


def folder_of(coders):
    out = number(len(coders))
    for method, properties in coders:
        out += bytes([len(method) | (32 if properties else 0)]) + method + (number(len(properties)) + properties if properties else b"")
    return out + b"".join(number(k) + number(k + 1) for k in range(len(coders) - 1))


def archive(folders, empty=(), encoded=False, spoil=False):
    """A 7z archive of folders, each (coders, {name: body}), and of empty files."""
    bodies = [b"".join(files.values()) for _, files in folders]
    streams = [packed(b, c) for b, (c, _) in zip(bodies, folders)]
    info = b"\x06" + number(0) + number(len(streams)) + b"\x09" + b"".join(number(len(s)) for s in streams) + b"\0"
    info += b"\x07\x0b" + number(len(folders)) + b"\0" + b"".join(folder_of(c) for c, _ in folders) + b"\x0c" + b"".join(number(len(b)) for b, (c, _) in zip(bodies, folders) for _ in c) + b"\0"
    info += b"\x08\x0d" + b"".join(number(len(f)) for _, f in folders) + b"\x09" + b"".join(number(len(x)) for _, f in folders for x in list(f.values())[:-1])
    info += b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(x)) for _, f in folders for x in f.values()) + b"\0\0"
    names = [n for _, f in folders for n in f] + list(empty)
    text = b"\0" + "".join(n + "\0" for n in names).encode("utf-16-le")
    files = b"\x05" + number(len(names))
    if empty:
        bits = [n in empty for n in names]
        mask = bytes(sum(128 >> k for k in range(8) if at + k < len(bits) and bits[at + k]) for at in range(0, len(bits), 8))
        files += b"\x0e" + number(len(mask)) + mask
    header = b"\x01\x04" + info + files + b"\x11" + number(len(text)) + text + b"\0\0"
    data = bytearray(b"".join(streams))
    if spoil:
        data[len(data) // 2] ^= 0xFF
    if encoded:
        at, own = len(data), packed(header, [LZMA1])
        data += own
        header = b"\x17\x06" + number(at) + number(1) + b"\x09" + number(len(own)) + b"\0\x07\x0b" + number(1) + b"\0" + folder_of([LZMA1]) + b"\x0c" + number(len(header)) + b"\0\0"
    start = struct.pack("<QQI", len(data), len(header), zlib.crc32(header))
    return sevenzip.SIGNATURE + b"\0\4" + struct.pack("<I", zlib.crc32(start)) + start + bytes(data) + header


FILES = {"a/ä.txt": b"hello " * 500, "b.env": b"KEY=1", "big": bytes(range(1, 256)) * 300}


@pytest.mark.parametrize("coders", [[LZMA1], [LZMA2], [(b"\x03\x03\x01\x03", b""), LZMA2], [(b"\x03", b"\x03"), LZMA1], [(b"\x00", b"")], [(b"\x04\x01\x08", b"")], [(b"\x04\x02\x02", b"")]])
@pytest.mark.parametrize("encoded", [False, True])
def test_members_of_7z(coders, encoded):
    body = archive([(coders, FILES), ([LZMA2], {"second": b"2" * 70_000})], empty=("nothing",), encoded=encoded)
    assert list(sevenzip.members(body, 1 << 20, 1 << 21)) == [*((n, b, None) for n, b in FILES.items()), ("second", b"2" * 70_000, None)]


def test_limits_and_damage_of_7z():
    body = archive([([LZMA2], FILES)])
    assert [(n, d and len(d), w) for n, d, w in sevenzip.members(body, 1000, 1 << 20)] == [("a/ä.txt", None, "too large"), ("b.env", 5, None), ("big", None, "too large")]
    assert {w for _, _, w in sevenzip.members(body, 1 << 20, 1000)} == {"too large"}
    assert all(w for _, _, w in sevenzip.members(archive([([LZMA1], {"x": random.Random(1).randbytes(3000)})], spoil=True), 1 << 20, 1 << 20))
    for cut in range(0, len(body), 7):
        with pytest.raises(sevenzip.Unreadable):
            list(sevenzip.members(body[:cut], 1 << 20, 1 << 20))


def test_7z_through_extraction(spark):
    inner = archive([([LZMA1], {"deep.txt": b"deep", "raw": b"\0\0"})])
    rows = [("x.7z", archive([([LZMA2], {"y.txt": b"why", "in.7z": inner})], encoded=True)), ("bad.7z", b"7z\xbc\xaf\x27\x1cnope")]
    found = extract.extract(spark.createDataFrame(rows, "path string, content binary"), report=True).collect()
    assert sorted(((r.path, r.member, r.content and bytes(r.content), r.left_out) for r in found), key=repr) == sorted(
        [("x.7z", "y.txt", b"why", None), ("x.7z", "in.7z:deep.txt", b"deep", None), ("x.7z", "in.7z:raw", None, "binary"), ("bad.7z", "", None, "damaged: Unreadable")], key=repr
    )


def stream(body, extra=b"", packed_=True):
    data = zlib.compress(body) if packed_ else body
    return b"<< /Length %d %s%s >>\nstream\n" % (len(data), b"/Filter /FlateDecode " if packed_ else b"", extra) + data + b"\nendstream"


CMAP = b"/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <00e9> <0002> <d83dde00> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <0079>] endbfrange"


def pdf_file(table=True, objects_inside=True):
    """Five pages: plain and hex strings, a font with codes of its own, differences, forms, several streams, inherited resources."""
    resources = b"<< /Font << /F1 5 0 R /F2 6 0 R /F3 7 0 R >> /XObject << /X1 8 0 R >> >>"
    fonts = {5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", 6: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 9 0 R >>", 7: b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /uni0416 /x 200 /u1F600] >> >>"}
    pages = [
        b"BT /F1 12 Tf 10 10 Td (Hello \\(PDF\\) \\351) Tj 0 -14 Td (second line) Tj ET", b"BT /F2 12 Tf <00010002> Tj [<0010> -300 <00110012> 5 <00200021>] TJ ET",
        b"BT /F3 9 Tf (AB\\310C) Tj ET q /X1 Do Q", b"BT /F1 8 Tf (token = ) Tj (\"0123\") ' ET % (no text)\nBI /W 1 ID (binary) Tj EI BT (after) Tj ET", b"",
    ]
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 5 /Resources " + resources + b" >>"}
    objects[3] = b"<< /Type /Pages /Parent 2 0 R /Kids [20 0 R 21 0 R] >>"
    objects[4] = b"<< /Type /Pages /Parent 2 0 R /Kids [22 0 R 23 0 R 24 0 R] >>"
    objects |= fonts
    objects[8] = stream(b"BT /F1 9 Tf (in a form) Tj ET", b"/Type /XObject /Subtype /Form ")
    objects[9] = stream(CMAP)
    for k, page in enumerate(pages):
        objects[20 + k] = b"<< /Type /Page /Contents %s >>" % (b"[%d 0 R 40 0 R]" % (30 + k) if k == 4 else b"%d 0 R" % (30 + k))
        objects[30 + k] = stream(page, packed_=k != 3)
    objects[34], objects[40] = stream(b"BT /F1 9 Tf (split text)"), stream(b"Tj ET")
    if objects_inside:
        inner = [n for n in (1, 2, 3, 5, 6, 7, 20, 21)]
        parts, at = b"", []
        for n in inner:
            at.append(b"%d %d" % (n, len(parts)))
            parts += objects.pop(n) + b" "
        head = b" ".join(at) + b" "
        objects[50] = stream(head + parts, b"/Type /ObjStm /N %d /First %d " % (len(inner), len(head)))
    out = b"%PDF-1.5\n%\xe2\xe3\n" + b"1 0 obj\n<< /Type /Old >>\nendobj\n" * (not objects_inside)
    for n, body in objects.items():
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    return out + (b"xref\n0 1\ntrailer\n<< /Root 1 0 R >>\nstartxref\n0\n%%EOF" if table else b"")


WANT = "Hello (PDF) é\nsecond line\n" + "é😀A BCxy\n" + "Жx😀C\nin a form\n" + "token = \n\"0123\"\nafter\n" + "split text\n"


@pytest.mark.parametrize("table", [True, False])
@pytest.mark.parametrize("inside", [True, False])
def test_text_of_five_pages(table, inside):
    problems = []
    assert pdf.text(pdf_file(table, inside), 1 << 20, problems).replace("\n\n", "\n") == WANT and problems == []


def test_predictors():
    rows = [bytes(range(k, k + 5)) for k in range(6)]
    file = pdf.File(b"%PDF-1.5", 1000)
    before, body = bytes(5), b""
    for k, row in enumerate(rows):
        a = bytes([0, *row[:-1]])
        c = bytes([0, *before[:-1]])
        near = [min((abs(y - z), 0, x), (abs(x - z), 1, y), (abs(x + y - 2 * z), 2, z))[2] for x, y, z in zip(a, before, c)]
        base = [bytes(5), a, before, bytes((x + y) // 2 for x, y in zip(a, before)), bytes(near)][k % 5]
        body += bytes([k % 5]) + bytes((x - y) & 255 for x, y in zip(row, base))
        before = row
    assert file._predicted(body, {"Predictor": 15, "Columns": 5}) == b"".join(rows)


def test_damaged_encrypted_and_large_files_are_told():
    told = lambda data, most=1 << 20: (pdf.text(data, most, problems := []), problems)
    assert told(b"no pdf")[1] == ["damaged: no PDF"] and told(b"%PDF-1.4 nothing")[1] == ["damaged: no pages"]
    assert told(pdf_file().replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")) == ("", ["encrypted"])
    assert "too large" in told(pdf_file(objects_inside=False), 40)[1]
    assert "damaged: stream" in told(pdf_file(objects_inside=False).replace(zlib.compress(b"BT /F1 9 Tf (in a form) Tj ET"), b"x" * 20))[1]
    body = pdf_file()
    for cut in range(10, len(body), 53):
        told(body[:cut])  # whatever is left, no error
    rng = random.Random(5)
    for _ in range(60):
        spoilt = bytearray(body)
        for _ in range(5):
            spoilt[rng.randrange(len(spoilt))] = rng.randrange(256)
        told(bytes(spoilt))
    told(b"%PDF-1.4 1 0 obj [" + b"[" * 5000)


def test_pdf_through_extraction(spark):
    frame = spark.createDataFrame([("d/x.PDF", pdf_file()), ("bad.pdf", b"%PDF-1.4")], "path string, content binary")
    found = sorted(((r.path, r.member, r.content and bytes(r.content).decode(), r.left_out) for r in extract.extract(frame, report=True).collect()), key=repr)
    assert [(p, m, w) for p, m, _, w in found] == [("bad.pdf", "content", "damaged: no pages"), ("d/x.PDF", "content", None)]
    assert 'token = \n"0123"' in found[1][2]
