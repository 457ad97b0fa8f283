"""Pages and bookmarks of PDF files: a small reader, and its use as a table with a row for each page.

It reads plain and deflated streams, object streams, and text in fonts that map to Unicode or are Latin; what it cannot
read is left out. Encrypted files give no pages.
"""

from __future__ import annotations

import json
import pickle
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.functions import text as X

#: Pages that one row of work holds, bytes of a file whose pages are read by several tasks, and bytes of a batch of rows.
PAGES_AT_A_TIME, LONG_FILE, BATCH_BYTES = 200, 8 << 20, 1 << 20
#: A shift to the left, in thousandths of the font's size, that counts as a space.
SPACE = 200

_TOKEN = re.compile(rb"(?:[\x00\t\n\f\r ]|%[^\r\n]*)*(<<|>>|[\[\](){}<]|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|[^\x00\t\n\f\r ()<>\[\]{}/%]+)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_BLANK = b"\x00\t\n\f\r "
_NUMBERED = re.compile(rb"(\d+)[\x00\t\n\f\r ]+\d+[\x00\t\n\f\r ]+\Z")
_WHOLE, _REAL = re.compile(rb"[+-]?\d+"), re.compile(rb"[+-]?\d*\.\d*")
_BEGIN, _END = re.compile(rb"stream\r?\n?"), re.compile(rb"[\r\n ]*endstream")
#: White space as the results define it, and what str.split() takes for it or not otherwise.
_SPACES, _UNLIKE = re.compile(f"[{X.WS}]+"), "\x1c\x1d\x1e\x1f\x85\ufeff"

#: A stream as it is in its file, and how often it is deflated.
Raw = tuple[bytes, int]
#: What a page's lines are read from: its contents, and the maps of its fonts by name.
Parts = tuple[list[Raw], dict[str, Raw | None]]


class Codes(dict[int, str]):
    """A font's map from codes to text, filled as codes are met. ranges: first and last code, first unit, bytes of it."""

    def __init__(self, width: int, known: dict[int, str], ranges: list[tuple[int, int, int, int]]):
        super().__init__(known)
        self.width, self.ranges = width, ranges
        below = 0
        for low, high, to, size in sorted(ranges):
            below = high + 1 if low <= below <= high and low == to and size == 2 else below
        #: Whether every code is the UTF-16 unit that it maps to.
        self.utf16 = width == 2 and not known and below > 65535 and all(low == to and size == 2 for low, _, to, size in ranges)

    def __missing__(self, code: int) -> str:
        low, _, to, size = next((x for x in self.ranges if x[0] <= code <= x[1]), (0, 0, 0, 0))
        unit = to + code - low
        self[code] = found = unit.to_bytes(size, "big").decode("utf-16-be", "surrogatepass") if size and unit < 256**size else ""
        return found


class Ref(int):
    """A reference to an object by its number."""


class Name(str):
    pass


class Word(str):
    """An operator or keyword."""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses, which may be nested, from behind the first one."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
            nxt = data[at + 1 : at + 2]
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            out += b"" if nxt in (b"\n", b"\r") else _ESCAPES.get(nxt, nxt)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


#: Words that come often, made once.
_OPERATORS = {w.encode(): Word(w) for w in ("Tj", "TJ", "T*", "Td", "TD", "Tm", "Tf", "TL", "BT", "ET", "'", '"', "R", "obj", "endobj")}


def _number(t: bytes) -> int | float | Word:
    if t.isdigit() or _WHOLE.fullmatch(t):
        return int(t)
    return float(t) if _REAL.fullmatch(t) and t.strip(b"+-") != b"." else Word(t.decode("latin-1"))


def _hexed(digits: bytes) -> bytes | None:
    """The bytes of hexadecimal digits with white space; None if there is something else."""
    for tidy in (lambda x: x, lambda x: (x := re.sub(rb"\s", b"", x)) + b"0" * (len(x) % 2)):  # white space may part a pair
        try:
            return bytes.fromhex(tidy(digits).decode())
        except ValueError:
            continue
    return None


def _places(data: bytes) -> dict[int, int]:
    """Where each object's value begins, by its number: behind "number generation obj"."""
    out, at = {}, data.find(b"obj")
    while at >= 0:
        if at and data[at - 1] in _BLANK and not re.match(rb"\w", data[at + 3 : at + 4]):
            low = max(0, at - 32)
            while low and not data[low:at].strip(b"0123456789" + _BLANK):  # the numbers may begin before it
                low = max(0, at - 2 * (at - low))
            if m := _NUMBERED.search(data[low:at]):
                out[int(m[1])] = at + 3
        at = data.find(b"obj", at + 3)
    return out


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """The values from a place on, each with the place behind it; arrays and dictionaries are whole values."""
    stack: list[list] = []
    while m := _TOKEN.match(data, at):
        t, at = m[1], m.end()
        first = t[0]
        if t == b"<<" or first == 0x5B:  # [
            stack.append([t])
            continue
        if first == 0x3C:  # <
            end = data.find(b">", at)
            if end < 0 or (value := _hexed(data[at:end])) is None:
                return
            at = end + 1
        elif first in b"+-.0123456789":
            value = _number(t)
        elif first == 0x2F:  # /
            value = Name((re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), t[1:]) if b"#" in t else t[1:]).decode("latin-1"))
        elif first == 0x28:  # (
            value, at = _literal(data, at)
        elif t == b">>" or t == b"]":
            items = stack.pop()[1:] if stack else []
            value = dict(zip(items[::2], items[1::2], strict=False)) if t == b">>" else items
        else:
            value = _OPERATORS.get(t) or Word(t.decode("latin-1"))
        if stack:
            if t == b"R" and len(stack[-1]) > 2:
                value = Ref(stack[-1][-2])
                del stack[-1][-2:]
            stack[-1].append(value)
        else:
            yield value, at


class Document:
    """The objects of a file by number, read when they are asked for; later ones of a number replace earlier ones."""

    def __init__(self, data: bytes):
        self.data, self.made = data, {}
        self.ends: dict[Ref, int] = {}
        self.maps: dict[Ref, Raw] = {}
        self.codes: dict[Raw, Codes] = {}
        self.leaves: list[dict] | None = None
        self.named: dict[str, object] | None = None
        self.places = _places(data)
        self.inner: dict[int, object] = {}
        for n in self._near(b"/ObjStm"):
            self._unpack(n)
        trailers = list(self._trailers())
        roots = [x["Root"] for x in trailers if "Root" in x]
        self.root = self.get(roots[-1]) if roots else next((o for n in self.places if isinstance(o := self.get(Ref(n)), dict) and o.get("Type") == "Catalog"), {})
        self.encrypted = any("Encrypt" in x for x in trailers)

    def _near(self, word: bytes) -> list[int]:
        """The objects with a word near their beginning."""
        return [n for n, at in self.places.items() if self.data.find(word, at, at + 300) >= 0] if word in self.data else []

    def _trailers(self) -> Iterator[dict]:
        at = self.data.find(b"trailer")
        while at >= 0:
            value = next(tokens(self.data, at + 7), ({}, 0))[0]
            if isinstance(value, dict):
                yield value
            at = self.data.find(b"trailer", at + 7)
        for n in self._near(b"/XRef"):
            if isinstance(x := self.get(Ref(n)), dict):
                yield x

    def _unpack(self, n: int) -> None:
        head, body = self.get(Ref(n)), self.stream(Ref(n))
        if isinstance(head, dict) and isinstance(head.get("First"), int):
            numbers = [v for v, _ in tokens(body[: head["First"]]) if isinstance(v, int)]
            for k, offset in zip(numbers[::2], numbers[1::2], strict=False):
                self.inner[k] = next(tokens(body, head["First"] + offset), (None, 0))[0]

    def get(self, x: object) -> object:
        """The value that a reference stands for, or the value itself."""
        for _ in range(20):
            if not isinstance(x, Ref):
                return x
            if x not in self.made:
                self.made[x], self.ends[x] = next(tokens(self.data, self.places[x]), (None, 0)) if x in self.places else (self.inner.get(int(x)), 0)
            x = self.made[x]
        return None

    def stream(self, ref: object) -> bytes:
        """The bytes of a stream, inflated; empty if it has another filter."""
        return _inflated(self.raw(ref))

    def raw(self, ref: object) -> Raw:
        head = self.get(ref)
        if not isinstance(ref, Ref) or ref not in self.places or not isinstance(head, dict):
            return b"", 0
        begin = _BEGIN.search(self.data, self.ends[ref])
        if begin is None:
            return b"", 0
        size = self.get(head.get("Length"))
        end = begin.end() + size if isinstance(size, int) and _END.match(self.data, begin.end() + size) else self.data.find(b"endstream", begin.end())
        filters = self.get(head.get("Filter"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        return (self.data[begin.end() : end], len(filters)) if all(f == "FlateDecode" for f in filters) else (b"", 0)

    def pages(self) -> list[dict]:
        """The pages in order, with what they inherit."""
        if self.leaves is not None:
            return self.leaves
        self.leaves = out = []
        stack, seen = [(self.root.get("Pages"), {})], set()
        while stack:
            ref, given = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and ref in seen:
                continue
            seen.add(ref if isinstance(ref, Ref) else id(node))
            given = given | {k: node[k] for k in ("Resources",) if k in node}
            if "Kids" in node:
                stack += [(k, given) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                out.append(given | node | {"ref": ref})
        return out

    def count(self) -> int:
        """How many pages the file says it has, those read at least."""
        told = (self.get(self.root.get("Pages")) or {}).get("Count")
        return max(told if isinstance(told, int) else 0, len(self.pages()))

    def parts(self, page: dict) -> Parts:
        """What a page's lines are read from."""
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        maps = {}
        for name, ref in fonts.items():
            to = (self.get(ref) or {}).get("ToUnicode")
            if to is not None and to not in self.maps:
                self.maps[to] = self.raw(to)
            maps[name] = None if to is None else self.maps[to]
        body = self.get(page.get("Contents"))
        return [self.raw(p) for p in (body if isinstance(body, list) else [page.get("Contents")])], maps

    def lines(self, page: dict) -> list[str]:
        """The lines of text of a page, without blank ones."""
        return _lines(self.parts(page), self.codes)

    def bookmarks(self) -> list[dict]:
        """The outline as nested title, page (from 1, 0 if unknown) and items."""
        places = {p["ref"]: k + 1 for k, p in enumerate(self.pages()) if isinstance(p["ref"], Ref)}
        seen: set[int] = set()

        def page_of(node: dict) -> int:
            action = self.get(node.get("A")) or {}
            dest = self.get(node.get("Dest", action.get("D") if isinstance(action, dict) else None))
            if isinstance(dest, bytes | str):
                dest = self._named(dest.decode("latin-1") if isinstance(dest, bytes) else dest)
            dest = self.get(dest.get("D")) if isinstance(dest, dict) else dest
            first = dest[0] if isinstance(dest, list) and dest else None
            return places.get(first, 0) if isinstance(first, Ref) else first + 1 if isinstance(first, int) else 0

        top: list[dict] = []
        stack = [((self.get(self.root.get("Outlines")) or {}).get("First"), top)]
        while stack:
            ref, out = stack.pop()
            node = self.get(ref) if isinstance(ref, Ref) and ref not in seen else None
            if not isinstance(node, dict):
                continue
            seen.add(ref)
            title = self.get(node.get("Title"))
            out.append({"title": _title(title) if isinstance(title, bytes) else "", "page": page_of(node), "items": []})
            stack += [(node.get("Next"), out), (node.get("First"), out[-1]["items"])]
        return top

    def _named(self, name: str) -> object:
        if self.named is None:
            self.named, seen = {}, set()
            stack = [(self.get(self.root.get("Names")) or {}).get("Dests")]
            while stack:
                ref = stack.pop()
                if isinstance(ref, Ref):
                    if ref in seen:
                        continue
                    seen.add(ref)
                node = self.get(ref) or {}
                names = self.get(node.get("Names")) or []
                for key, value in zip(names[::2], names[1::2], strict=False):
                    if isinstance(key, bytes):
                        self.named.setdefault(key.decode("latin-1"), value)
                stack += self.get(node.get("Kids")) or []
        return self.get(self.named[name] if name in self.named else (self.get(self.root.get("Dests")) or {}).get(name))


def _inflated(raw: Raw) -> bytes:
    body, times = raw
    for _ in range(times):
        body = zlib.decompressobj().decompress(body)
    return body


def _lines(parts: Parts, codes: dict[Raw, Codes]) -> list[str]:
    """codes: the fonts' maps that were read before, which it adds to."""
    bodies, maps = parts
    for x in maps.values():
        if x is not None and x not in codes:
            codes[x] = _to_unicode(_inflated(x))
    font, args, out = None, [], [""]
    for value, _ in tokens(b"\n".join(_inflated(x) for x in bodies)):
        if not isinstance(value, Word):
            args.append(value)
            continue
        if value == "Tf" and args:
            known = maps.get(args[0]) if isinstance(args[0], str) else None
            font = None if known is None else codes[known]
        elif value in ("Td", "TD") and len(args) > 1 and args[1] or value in ("T*", "Tm", "BT", "'", '"'):
            out.append("")
        if value in ("Tj", "'", '"', "TJ") and args:
            shown = args[-1] if isinstance(args[-1], list) else [args[-1]]
            out[-1] += "".join(_decoded(x, font) if isinstance(x, bytes) else " " if isinstance(x, int | float) and -x > SPACE else "" for x in shown)
        args = []
    whole = "".join(out)
    unlike = any(c in whole for c in _UNLIKE)
    squeezed = (_SPACES.sub(" ", line).strip(" ") if unlike else " ".join(line.split()) for line in out)
    return [line for line in squeezed if line]


def _title(b: bytes) -> str:
    return b[2:].decode("utf-16-be", "replace") if b[:2] == b"\xfe\xff" else b.decode("cp1252", "replace")


@lru_cache(maxsize=8)  # files of one origin often have the same maps
def _to_unicode(body: bytes) -> Codes:
    values, known, ranges, width = [], {}, [], 1
    text = lambda b: b.decode("utf-16-be", "replace")
    for value, _ in tokens(body):
        if not isinstance(value, Word):
            values.append(value)
            continue
        if value == "endcodespacerange":
            width = max((len(v) for v in values if isinstance(v, bytes)), default=1)
        elif value == "endbfchar":
            known |= {int.from_bytes(a, "big"): text(b) for a, b in zip(values[::2], values[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif value == "endbfrange":
            for a, b, to in zip(values[::3], values[1::3], values[2::3], strict=False):
                low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                if isinstance(to, list):
                    known |= {low + k: text(x) for k, x in enumerate(to) if low + k <= high}
                else:
                    ranges.append((low, high, int.from_bytes(to, "big"), max(2, len(to))))
        values = []
    return Codes(width, known, ranges)


def _decoded(b: bytes, font: Codes | None) -> str:
    if font is None:
        return b.decode("cp1252", "replace")
    if font.utf16 and len(b) % 2 == 0:
        return b.decode("utf-16-be", "replace")
    width = font.width
    codes = b if width == 1 else struct.unpack(f">{len(b) // 2}H", b) if width == 2 and len(b) % 2 == 0 else [int.from_bytes(b[k : k + width], "big") for k in range(0, len(b), width)]
    whole = "".join(map(font.__getitem__, codes))
    return whole if whole.isascii() else whole.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")  # halves of a pair come as two codes


def opened(data: bytes) -> Document | None:
    """The document, or None if it cannot be read."""
    try:
        doc = Document(data)
        return None if doc.encrypted or not doc.pages() else doc
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, zlib.error, RecursionError):
        return None


def lines_of(doc: Document, page: dict) -> list[str]:
    """A page's lines; none if it cannot be read, so that one bad page does not lose the rest."""
    return _lines_of(_parts_of(doc, page), doc.codes)


def _parts_of(doc: Document, page: dict) -> Parts:
    try:
        return doc.parts(page)
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, zlib.error):
        return [], {}


def _lines_of(parts: Parts, codes: dict[Raw, Codes]) -> list[str]:
    try:
        return _lines(parts, codes)
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, zlib.error):
        return []


def bookmarks_of(doc: Document) -> str | None:
    """The bookmarks as JSON; None without any."""
    try:
        found = doc.bookmarks()
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError):
        return None
    return json.dumps(found) if found else None


def _batches(ids: pa.Array, rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some BATCH_BYTES. rows: place among the ids, other columns, bytes."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        places, *columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(places, pa.int32())), *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], ["doc_id", *schema.names])

    for *row, n in rows:
        held.append(row)
        size += n
        if size > BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def page_rows(files: DataFrame, at_a_time: int = PAGES_AT_A_TIME, long: int = LONG_FILE) -> DataFrame:
    """files: doc_id, content -> doc_id, page (from 1), lines.

    A file is opened once. Its pages are read there, but for files of more than ``long`` bytes: their pages' streams are
    cut out of them, and read by several tasks, each some pages of a file.
    """
    read_there = pa.schema([("page", pa.int32()), ("lines", pa.list_(pa.string()))])
    cut_out = read_there.append(pa.field("work", pa.binary()))

    def cut(content: pa.Array) -> Iterator[tuple]:
        for k, b in enumerate(content):
            b = b.as_py() or b""
            doc = opened(b)
            pages = doc.pages() if doc else []
            if len(b) <= long:
                for n, p in enumerate(pages):
                    yield k, n + 1, (lines := lines_of(doc, p)), None, 50 + sum(map(len, lines))
            else:
                for low in range(0, len(pages), at_a_time):
                    yield k, low + 1, None, (work := pickle.dumps([_parts_of(doc, p) for p in pages[low : low + at_a_time]])), len(work)

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k, (page, lines, work) in enumerate(zip(batch["page"].to_pylist(), batch["lines"], batch["work"], strict=True)):
            codes: dict[Raw, Codes] = {}
            for n, parts in enumerate(pickle.loads(work.as_py()) if work.is_valid else [None]):
                found = lines.as_py() if parts is None else _lines_of(parts, codes)
                yield k, page + n, found, 50 + sum(map(len, found))

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(batch["doc_id"], cut(batch["content"]), cut_out)

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from [batch.select(["doc_id", *read_there.names])] if batch["work"].null_count == len(batch) else _batches(batch["doc_id"], read(batch), read_there)

    out = T.StructType([files.schema["doc_id"], T.StructField("page", T.IntegerType()), T.StructField("lines", T.ArrayType(T.StringType()))])
    work = files.select("doc_id", "content").mapInArrow(cut_all, T.StructType([*out, T.StructField("work", T.BinaryType())]))
    return work.repartition("doc_id", "page").mapInArrow(read_all, out)
