"""The text layer of PDF files by random access: only what the asked pages need is read.

Cross-reference tables and streams, object streams, uncompressed and Flate content, and fonts of one
byte (Windows-1252) or with a ToUnicode map are known; encrypted files and other filters are errors.
`write` makes files with a text layer.
"""

from __future__ import annotations

import re
import zlib

SPACE = rb"\x00\t\n\f\r "
PART = re.compile(rb"(?:[" + SPACE + rb"]+|%[^\r\n]*)*(<<|>>|[\[\]({}]|<[0-9A-Fa-f" + SPACE + rb"]*>|/[^" + SPACE + rb"()<>\[\]{}/%]*|[^" + SPACE + rb"()<>\[\]{}/%]+)")
REFERENCE = re.compile(rb"[" + SPACE + rb"]+(\d+)[" + SPACE + rb"]+R(?![A-Za-z0-9])")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A PDF name."""


class Word(str):
    """A keyword or an operator."""


class Ref(int):
    """The number of an indirect object."""


def string_at(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose bracket ends before `at`."""
    out, depth = bytearray(), 1
    while True:
        c = data[at : at + 1]
        if not c:
            raise ValueError("string not closed")
        at += 1
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            else:
                line = re.compile(rb"\r\n|\r|\n").match(data, at)
                out += b"" if line else ESCAPES.get(data[at : at + 1], data[at : at + 1])
                at = line.end() if line else at + 1
            continue
        depth += {b"(": 1, b")": -1}.get(c, 0)
        if depth == 0:
            return bytes(out), at
        out += c


def value_at(data: bytes, at: int):
    """The object that begins at `at`, and where it ends."""
    m = PART.match(data, at)
    if m is None:
        raise ValueError("object expected")
    part, at = m[1], m.end()
    if part == b"(":
        return string_at(data, at)
    if part in (b"<<", b"["):
        items = []
        while True:
            one, at = value_at(data, at)
            if one in (">>", "]") and isinstance(one, Word):
                return (dict(zip(items[::2], items[1::2], strict=True)) if part == b"<<" else items), at
            items.append(one)
    if part[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", part)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
    if part[:1] == b"/":
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), part[1:]).decode("latin-1")), at
    if part.isdigit() and (ref := REFERENCE.match(data, at)):
        return Ref(part), ref.end()
    try:
        return (float(part) if b"." in part else int(part)), at
    except ValueError:
        return {b"true": True, b"false": False, b"null": None}.get(part, Word(part.decode("latin-1"))), at


def unpacked(data: bytes, parms: dict | None) -> bytes:
    """Flate data, with the row predictors of PNG that cross-reference streams use."""
    data = zlib.decompressobj().decompress(data)
    if not parms or parms.get("Predictor", 1) < 10:
        return data
    width = parms.get("Columns", 1)
    out, before = bytearray(), bytes(width)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], data[at + 1 : at + 1 + width]
        if kind not in (0, 2):
            raise ValueError("predictor not supported")
        before = row if kind == 0 else bytes((a + b) & 255 for a, b in zip(row, before, strict=False))
        out += before
    return bytes(out)


class Pdf:
    """A file given by its size and a function (offset, length) -> bytes."""

    def __init__(self, size: int, read) -> None:
        self.size, self.read, self.at, self.trailer, self.held = size, read, {}, {}, {}
        tail = read(max(0, size - 2048), 2048)
        starts = re.findall(rb"startxref[" + SPACE + rb"]+(\d+)", tail)
        if not starts:
            raise ValueError("no cross-reference")
        todo, seen = [int(starts[-1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            found = self.grown(at, self._table) if read(at, 4) == b"xref" else self._stream_table(at)
            self.trailer = found | self.trailer
            todo += [int(found[k]) for k in ("XRefStm", "Prev") if found.get(k) is not None]
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted")

    def grown(self, at: int, parse):
        """parse(bytes from `at` on), with ever more of them until it has enough."""
        length = 4096
        while True:
            data = self.read(at, length)
            try:
                return parse(data)
            except (ValueError, IndexError):
                if at + length >= self.size:
                    raise
                length *= 8

    def _table(self, data: bytes) -> dict:
        lines = re.compile(rb"[" + SPACE + rb"]*(\d+)[" + SPACE + rb"]+(\d+)[" + SPACE + rb"]+")
        entry = re.compile(rb"(\d{10}) (\d{5}) ([nf])[" + SPACE + rb"]{1,2}")
        at = 4
        while m := lines.match(data, at):
            at, first, count = m.end(), int(m[1]), int(m[2])
            for number in range(first, first + count):
                e = entry.match(data, at)
                if e is None:
                    raise ValueError("cross-reference entry expected")
                if e[3] == b"n":
                    self.at.setdefault(number, int(e[1]))
                at = e.end()
        word, at = value_at(data, at)
        if word != "trailer":
            raise ValueError("no trailer")
        return value_at(data, at)[0]

    def _stream_table(self, at: int) -> dict:
        d, start = self.object_at(at)
        data, w = self.decoded(d, start), d["W"]
        index = d.get("Index") or [0, d["Size"]]
        numbers = [n for a, c in zip(index[::2], index[1::2], strict=True) for n in range(a, a + c)]
        for i, number in enumerate(numbers):
            row = data[i * sum(w) : (i + 1) * sum(w)]
            kind, a, b = (int.from_bytes(row[sum(w[:k]) : sum(w[: k + 1])], "big") if w[k] else 1 for k in range(3))
            if kind:
                self.at.setdefault(number, a if kind == 1 else (a, b))
        return d

    def object_at(self, at: int):
        """The object `n g obj` at an offset, and where its stream begins (None without one)."""

        def parse(data: bytes):
            pos = 0
            for _ in range(2):
                _, pos = value_at(data, pos)
            word, pos = value_at(data, pos)
            if word != "obj":
                raise ValueError("object expected")
            got, pos = value_at(data, pos)
            end, pos = value_at(data, pos)
            if end != "stream":
                return got, None
            if pos + 2 > len(data):
                raise ValueError("stream expected")
            return got, at + pos + (2 if data[pos : pos + 2] == b"\r\n" else 1)

        return self.grown(at, parse)

    def decoded(self, d: dict, start: int) -> bytes:
        data = self.read(start, int(self.get(d["Length"])))
        filters, parms = self.get(d.get("Filter")) or [], self.get(d.get("DecodeParms"))
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                raise ValueError(f"filter {f} not supported")
            data = unpacked(data, parms[0] if isinstance(parms, list) else parms)
        return data

    def get(self, x):
        """x, or the object that it refers to."""
        if not isinstance(x, Ref):
            return x
        if x not in self.held:
            at = self.at.get(int(x))
            if at is None:
                return None
            if isinstance(at, tuple):
                d, start = self.object_at(self.at[at[0]])
                data = self.decoded(d, start)
                heads = [int(n) for n in data[: d["First"]].split()]
                self.held[x] = value_at(data, d["First"] + heads[2 * at[1] + 1])[0]
            else:
                self.held[x] = self.object_at(at)[0]
        return self.held[x]

    def stream(self, x) -> bytes:
        """Content of a stream, or of a list of streams."""
        whole = self.get(x) if not isinstance(x, Ref) or isinstance(self.get(x), list) else None
        if isinstance(whole, list):
            return b"\n".join(self.stream(one) for one in whole)
        d, start = self.object_at(self.at[int(x)])
        return self.decoded(d, start)

    @property
    def n_pages(self) -> int:
        return int(self.get(self.get(self.get(self.trailer["Root"])["Pages"])["Count"]))

    def page(self, n: int) -> dict:
        """The n-th page (from 0) with what it inherits; branches without it are passed by their counts."""
        node = dict(self.get(self.get(self.trailer["Root"])["Pages"]))
        while "Kids" in node:
            for kid in self.get(node["Kids"]):
                child = self.get(kid)
                count = int(self.get(child["Count"])) if "Kids" in child else 1
                if n < count:
                    node = {k: node[k] for k in ("Resources",) if k in node} | child
                    break
                n -= count
            else:
                raise ValueError("page not found")
        return node

    # ---- text ----
    def decoder(self, font: dict):
        """A function from a shown string to text."""
        if "ToUnicode" not in font:
            return lambda s: s.decode("cp1252", "replace")
        table, width = {}, 1
        data = self.stream(font["ToUnicode"])
        for part in re.findall(rb"begincodespacerange(.*?)endcodespacerange", data, re.S):
            width = max(width, max(len(x) for x in re.findall(rb"<([0-9A-Fa-f]+)>", part)) // 2)
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
            table.update({int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)})
        spans = [(int(a, 16), int(b, 16), int(c, 16)) for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S) for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)]

        def decode(s: bytes) -> str:
            units = bytearray()
            for i in range(0, len(s) - width + 1, width):
                code = int.from_bytes(s[i : i + width], "big")
                span = next((x for x in spans if x[0] <= code <= x[1]), None)
                units += table[code].encode("utf-16-be", "surrogatepass") if code in table else (span[2] + code - span[0] if span else 0xFFFD).to_bytes(2, "big")
            return units.decode("utf-16-be", "replace")

        return decode

    def shown(self, content: bytes, resources: dict, depth: int = 0):
        """(text, whether a new line begins before it) of a content stream's strings in turn."""
        fonts = self.get(resources.get("Font")) or {}
        decoders, decode, line, y, at, stack = {}, self.decoder({}), True, 0.0, 0, []
        while m := PART.match(content, at):
            one, at = value_at(content, m.start())
            if not isinstance(one, Word):
                stack.append(one)
                continue
            if one == "Tf":
                name = stack[-2]
                if name not in decoders:
                    decoders[name] = self.decoder(self.get(fonts.get(name)) or {})
                decode = decoders[name]
            elif one in ("Td", "TD"):
                line |= stack[-1] != 0
            elif one == "Tm":
                line, y = line or stack[-1] != y, stack[-1]
            elif one in ("T*", "'", '"', "BT"):
                line |= one != "BT"
            if one in ("Tj", "'", '"', "TJ"):
                parts = stack[-1] if one == "TJ" else [stack[-1]]
                said = "".join(decode(p) if isinstance(p, bytes) else " " if p < -200 else "" for p in parts)
                yield said, line
                line = False
            elif one == "Do" and depth < 5:
                form = (self.get(resources.get("XObject")) or {}).get(stack[-1])
                if form is not None and self.get(form).get("Subtype") == "Form":
                    yield from self.shown(self.stream(form), self.get(self.get(form).get("Resources")) or resources, depth + 1)
            elif one == "ID":  # an inline image
                at = content.index(b"EI", at) + 2
            stack = []

    def text(self, n: int) -> str:
        """The text layer of the n-th page (from 0), its lines ended by line breaks."""
        page = self.page(n)
        if page.get("Contents") is None:
            return ""
        out = ""
        for said, line in self.shown(self.stream(page["Contents"]), self.get(page.get("Resources")) or {}):
            out += ("\n" if line and out else "") + said
        return out


UNICODE_MAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"


def write(pages: list[str], packed: bool = True) -> bytes:
    """A PDF file with a text layer; each page's lines one below the other."""

    def stream(data: bytes, extra: bytes = b"") -> bytes:
        data = zlib.compress(data) if packed else data
        return b"<< /Length %d %s%s>>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if packed else b"", extra, data)

    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /DescendantFonts [] /ToUnicode 4 0 R >>", stream(UNICODE_MAP)]
    kids = []
    for text in pages:
        lines = [b"<%s> Tj" % line.encode("utf-16-be").hex().encode() for line in text.split("\n")]
        content = stream(b"BT /F1 11 Tf 50 800 Td 14 TL\n" + b"\nT*\n".join(lines) + b"\nET")
        kids.append(len(objects) + 1)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (len(objects) + 2))
        objects.append(content)
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out) + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, table, len(places) + 1, len(out))
