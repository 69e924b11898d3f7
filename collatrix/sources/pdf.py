"""PDF structure without its text: objects, cross references, streams, pages, and the graphics that a page places.

A file is one row; what can't be read gives a row with an error, never a failed job. Text decoding belongs to another
reader: tables of positioned text are the input of the layout operators.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed limits of the reader.
MOST_HOPS, MOST_DEPTH, MOST_NESTING = 8, 50, 3
RULE_THICK, RULE_LONG = 2, 20

TOKEN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
SPACE = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")
NUMBER = re.compile(rb"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\Z")
OBJECT_START = re.compile(rb"(?<![0-9])([0-9]+)[\x00\t\n\x0c\r ]+([0-9]+)[\x00\t\n\x0c\r ]+obj(?![a-zA-Z])")


class PdfError(ValueError):
    pass


class Name(str):
    """A name object."""


class Operator(str):
    """A keyword or content operator."""


class Ref(tuple):
    """(object number, generation)."""


class Stream:
    def __init__(self, entries: dict, raw: bytes) -> None:
        self.entries, self.raw = entries, raw


class Reader:
    """Objects from bytes. Strings keep no content beyond balance: nothing here depends on it."""

    def __init__(self, data: bytes, at: int = 0, references: bool = True) -> None:
        self.data, self.at, self.references = data, at, references

    def skip(self) -> None:
        self.at = SPACE.match(self.data, self.at).end()

    def value(self):
        """The next object or operator; None at the end."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            return None
        first = data[at : at + 1]
        if data.startswith(b"<<", at):
            self.at += 2
            return self._entries()
        if first == b"<":
            self.at = _end(data, b">", at)
            return ""
        if first == b"(":
            return self._string()
        if first == b"[":
            self.at += 1
            return self._items(b"]")
        if first == b"/":
            m = TOKEN.match(data, at + 1)
            self.at = m.end() if m else at + 1
            return Name(re.sub(rb"#([0-9a-fA-F]{2})", lambda h: bytes([int(h[1], 16)]), m[0]).decode("latin-1") if m else "")
        m = TOKEN.match(data, at)
        if not m:
            self.at += 2 if data.startswith(b">>", at) else 1
            return Operator(data[at : self.at].decode("latin-1"))
        self.at = m.end()
        if not NUMBER.match(m[0]):
            return {b"true": True, b"false": False, b"null": None}.get(m[0], Operator(m[0].decode("latin-1"))) if m[0] != b"null" else Operator("null")
        if self.references and m[0].isdigit():
            r = re.compile(rb"[\x00\t\n\x0c\r ]+([0-9]+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])").match(data, self.at)
            if r:
                self.at = r.end()
                return Ref((int(m[0]), int(r[1])))
        return float(m[0]) if b"." in m[0] else int(m[0])

    def _string(self) -> str:
        depth, at = 0, self.at
        while at < len(self.data):
            c = self.data[at]
            if c == 0x5C:
                at += 1
            elif c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
            at += 1
        self.at = at + 1
        return ""

    def _items(self, close: bytes) -> list:
        items = []
        while True:
            self.skip()
            if self.at >= len(self.data):
                return items
            if self.data.startswith(close, self.at):
                self.at += len(close)
                return items
            value = self.value()
            items.append(None if isinstance(value, Operator) and value == "null" else value)

    def _entries(self) -> dict:
        items = self._items(b">>")
        return {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}


def _end(data: bytes, mark: bytes, at: int) -> int:
    found = data.find(mark, at)
    return len(data) if found < 0 else found + len(mark)


def inflate(raw: bytes) -> bytes:
    """Zlib data as far as it can be read; without its header if that is what is broken."""
    for start, bits in ((0, 15), (2, -15)):
        unpacker, out = zlib.decompressobj(bits), b""
        try:
            out = unpacker.decompress(raw[start:]) + unpacker.flush()
            if out or unpacker.eof:
                return out
        except zlib.error:
            unpacker = zlib.decompressobj(bits)
            for i in range(start, len(raw), 64):
                try:
                    out += unpacker.decompress(raw[i : i + 64])
                except zlib.error:
                    break
            if out:
                return out
    raise PdfError("not zlib data")


def unpredicted(data: bytes, columns: int, colours: int = 1, bits: int = 8) -> bytes:
    """Undoes the row filters of PNG."""
    size, step = (columns * colours * bits + 7) // 8, max(1, colours * bits // 8)
    above, out = bytearray(size), bytearray()
    for at in range(0, len(data), size + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + size])
        for i in range(len(row)):
            left = row[i - step] if i >= step else 0
            up = above[i]
            if kind == 1:
                guess = left
            elif kind == 2:
                guess = up
            elif kind == 3:
                guess = (left + up) // 2
            elif kind == 4:
                corner = above[i - step] if i >= step else 0
                guess = min((left, up, corner), key=lambda g, t=left + up - corner: abs(t - g))
            else:
                guess = 0
            row[i] = (row[i] + guess) & 255
        out += row
        above = row.ljust(size, b"\0")
    return bytes(out)


class Pdf:
    """A file's objects, by cross references or, where those are broken, by searching for them."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.where: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.held: dict[int, object] = {}
        try:
            self._follow()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise PdfError("no root")
        except (PdfError, ValueError, KeyError, IndexError, TypeError, AttributeError):
            self._search()

    def _follow(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise PdfError("no startxref")
        todo, seen = [int(re.match(rb"startxref\s+([0-9]+)", self.data[at:])[1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            reader = Reader(self.data, at)
            reader.skip()
            entries = self._table(reader) if self.data.startswith(b"xref", reader.at) else self._packed_table(reader)
            for k, v in entries.items():
                self.trailer.setdefault(k, v)
            todo += [int(entries[k]) for k in ("XRefStm", "Prev") if isinstance(entries.get(k), (int, float))]

    def _table(self, reader: Reader) -> dict:
        reader.at += 4
        while True:
            first = reader.value()
            if not isinstance(first, int):
                break
            for n in range(first, first + int(reader.value())):
                offset, _, kind = reader.value(), reader.value(), reader.value()
                if kind == "n":
                    self.where.setdefault(n, ("at", offset))
        trailer = reader.value()
        if first != "trailer" or not isinstance(trailer, dict):
            raise PdfError("no trailer")
        return trailer

    def _packed_table(self, reader: Reader) -> dict:
        stream = self._indirect(reader.at)
        if not isinstance(stream, Stream):
            raise PdfError("no cross references")
        widths = stream.entries["W"]
        index = stream.entries.get("Index") or [0, stream.entries["Size"]]
        data, at = self.decoded(stream), 0
        for first, count in zip(index[::2], index[1::2]):
            for n in range(first, first + count):
                fields = []
                for w in widths:
                    fields.append(int.from_bytes(data[at : at + w], "big"))
                    at += w
                kind = fields[0] if widths[0] else 1
                if kind == 1:
                    self.where.setdefault(n, ("at", fields[1]))
                elif kind == 2:
                    self.where.setdefault(n, ("in", fields[1], fields[2]))
        return stream.entries

    def _search(self) -> None:
        self.where = {int(m[1]): ("at", m.start()) for m in OBJECT_START.finditer(self.data)}
        self.held, self.trailer = {}, {}
        for m in re.finditer(rb"trailer", self.data):
            found = Reader(self.data, m.end()).value()
            if isinstance(found, dict):
                self.trailer |= found
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            for n in self.where:
                found = self.get(Ref((n, 0)))
                if isinstance(found, dict) and found.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref((n, 0))

    def _indirect(self, at: int):
        m = OBJECT_START.match(self.data, SPACE.match(self.data, at).end())
        if not m:
            raise PdfError(f"no object at {at}")
        reader = Reader(self.data, m.end())
        value = reader.value()
        reader.skip()
        if not isinstance(value, dict) or not self.data.startswith(b"stream", reader.at):
            return value
        start = re.compile(rb"stream(?:\r\n|\n|\r)?").match(self.data, reader.at).end()
        length = value.get("Length")
        length = self.get(length) if isinstance(length, Ref) else length
        end = start + length if isinstance(length, int) else -1
        if end < start or not re.match(rb"\s*endstream", self.data[end : end + 16]):
            found = self.data.find(b"endstream", start)
            end = len(self.data) if found < 0 else found
        return Stream(value, self.data[start:end])

    def get(self, value, hops: int = 0):
        """The object that a reference leads to; anything else as it is."""
        if not isinstance(value, Ref):
            return value
        if hops > MOST_HOPS or value[0] not in self.where:
            return None
        number = value[0]
        if number not in self.held:
            self.held[number] = None
            place = self.where[number]
            self.held[number] = self._indirect(place[1]) if place[0] == "at" else self._packed(place[1], number)
        return self.get(self.held[number], hops + 1)

    def _packed(self, holder: int, number: int):
        stream = self.get(Ref((holder, 0)))
        if not isinstance(stream, Stream):
            return None
        data = self.decoded(stream)
        head = Reader(data, 0, references=False)
        places = [(head.value(), head.value()) for _ in range(int(self.get(stream.entries["N"])))]
        offset = dict(places).get(number)
        return None if offset is None else Reader(data, int(self.get(stream.entries["First"])) + offset).value()

    def decoded(self, stream: Stream) -> bytes:
        many = lambda x: x if isinstance(x, list) else [] if x is None else [x]
        filters, options = many(self.get(stream.entries.get("Filter"))), many(self.get(stream.entries.get("DecodeParms")))
        data = stream.raw
        for i, name in enumerate(filters):
            if self.get(name) != "FlateDecode":
                raise PdfError(f"filter {name}")
            data = inflate(data)
            option = self.get(options[i]) if i < len(options) else None
            predictor = self.get(option.get("Predictor", 1)) if option else 1
            if predictor >= 10:
                data = unpredicted(data, *(self.get(option.get(k, d)) for k, d in (("Columns", 1), ("Colors", 1), ("BitsPerComponent", 8))))
            elif predictor != 1:
                raise PdfError(f"predictor {predictor}")
        return data

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with the resources they inherit."""
        out: list[dict] = []

        def walk(ref, resources, depth: int) -> None:
            if depth > MOST_DEPTH:
                raise PdfError("page tree too deep")
            node = self.get(ref)
            if not isinstance(node, dict):
                return
            own = node.get("Resources", resources)
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, own, depth + 1)
            else:
                out.append(node | {"Resources": own})

        walk(self.get(self.trailer.get("Root"))["Pages"], None, 0)
        return out

    def contents(self, page: dict) -> bytes:
        parts = self.get(page.get("Contents"))
        streams = [self.get(p) for p in (parts if isinstance(parts, list) else [parts])]
        return b"\n".join(self.decoded(s) for s in streams if isinstance(s, Stream))

    def fingerprint(self, value, depth: int = 0) -> bytes:
        """A digest of an object with what it refers to, nested drawings to a bounded depth."""
        value = self.get(value)
        if isinstance(value, Stream):
            kept = {k: v for k, v in value.entries.items() if k not in ("Length", "Resources", "Parent", "Metadata", "PieceInfo", "LastModified")}
            inner = (self.get(value.entries.get("Resources")) or {}).get("XObject") if depth < MOST_NESTING else None
            nested = [self.fingerprint(v, depth + 1) for _, v in sorted((self.get(inner) or {}).items())]
            return hashlib.sha256(b"|".join([repr(sorted(kept.items(), key=lambda e: e[0])).encode(), value.raw, *nested])).digest()
        return hashlib.sha256(repr(value).encode()).digest()


Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1, 0, 0, 1, 0, 0)


def times(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n, on row vectors."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


def placed_box(box, m: Matrix) -> tuple[float, float, float, float]:
    x0, y0, x1, y1 = box
    points = [(x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]) for x in (x0, x1) for y in (y0, y1)]
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


class PageScan:
    """The drawings and images that a page places itself, and its painted rules, in its own coordinates (y up)."""

    PAINTS = frozenset("S s f F f* B B* b b*".split())

    def __init__(self, pdf: Pdf, page: dict) -> None:
        self.pdf, self.graphics, self.rules = pdf, [], []
        resources = pdf.get(page.get("Resources")) or {}
        self.drawings = pdf.get(resources.get("XObject")) or {}
        self.matrix, self.saved, self.path = UNIT, [], []
        reader, operands = Reader(pdf.contents(page), references=False), []
        while (value := reader.value()) is not None or reader.at < len(reader.data):
            if not isinstance(value, Operator):
                operands.append(value)
                continue
            if value == "BI":
                found = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)").search(reader.data, reader.at)
                reader.at = found.end() if found else len(reader.data)
                self.graphics.append(("image", placed_box((0, 0, 1, 1), self.matrix), "inline"))
            else:
                self._do(value, operands)
            operands = []

    def _do(self, operator: str, operands: list) -> None:
        numbers = [v for v in operands if isinstance(v, (int, float))]
        if operator == "q":
            self.saved.append(self.matrix)
        elif operator == "Q":
            self.matrix = self.saved.pop() if self.saved else self.matrix
        elif operator == "cm" and len(numbers) == 6:
            self.matrix = times(tuple(numbers), self.matrix)
        elif operator == "Do" and operands and isinstance(operands[-1], Name):
            self._place(self.pdf.get(self.drawings.get(operands[-1])))
        elif operator == "re" and len(numbers) == 4:
            x, y, w, h = numbers
            self.path += [(x, y), (x + w, y + h)]
        elif operator in ("m", "l", "c", "v", "y"):
            self.path += list(zip(numbers[::2], numbers[1::2]))
        elif operator in self.PAINTS:
            if self.path:
                xs, ys = zip(*self.path)
                box = placed_box((min(xs), min(ys), max(xs), max(ys)), self.matrix)
                sides = sorted((box[2] - box[0], box[3] - box[1]))
                if sides[0] <= RULE_THICK and sides[1] >= RULE_LONG:
                    self.rules.append(box)
            self.path = []
        elif operator == "n":
            self.path = []

    def _place(self, drawing) -> None:
        if not isinstance(drawing, Stream):
            return
        kind = self.pdf.get(drawing.entries.get("Subtype"))
        if kind == "Form":
            own = [self.pdf.get(v) for v in self.pdf.get(drawing.entries.get("Matrix")) or UNIT]
            box = [self.pdf.get(v) for v in self.pdf.get(drawing.entries.get("BBox")) or (0, 0, 0, 0)]
            self.graphics.append(("form", placed_box(box, times(tuple(own), self.matrix)), self.pdf.fingerprint(drawing).hex()))
        elif kind == "Image":
            self.graphics.append(("image", placed_box((0, 0, 1, 1), self.matrix), self.pdf.fingerprint(drawing).hex()))


FOUND = "doc_id string, page int, kind string, x0 double, y0 double, x1 double, y1 double, hash string, error string"


def page_graphics(files: DataFrame) -> DataFrame:
    """Graphics (kind form or image), rules and pages of files (doc_id, content); pages have their media box."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
                try:
                    pdf = Pdf(content or b"")
                    for n, page in enumerate(pdf.pages()):
                        media = [float(pdf.get(v)) for v in pdf.get(page.get("MediaBox")) or (0, 0, 0, 0)]
                        out.append((doc, n, "page", *media, None, None))
                        try:
                            scan = PageScan(pdf, page)
                        except (PdfError, ValueError, TypeError, KeyError, IndexError, AttributeError) as error:
                            out.append((doc, n, "error", None, None, None, None, None, repr(error)[:200]))
                            continue
                        out += [(doc, n, kind, *map(float, box), digest, None) for kind, box, digest in scan.graphics]
                        out += [(doc, n, "rule", *map(float, box), None, None) for box in scan.rules]
                except (PdfError, ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError) as error:
                    out.append((doc, None, "error", None, None, None, None, None, repr(error)[:200]))
            columns = list(zip(*out)) or [()] * 9
            kinds = (pa.string(), pa.int32(), pa.string(), *[pa.float64()] * 4, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in FOUND.split(", ")])

    return files.select("doc_id", "content").mapInArrow(run, FOUND)
