"""What a reader of an e-mail sees: its headers and text parts with transfer encodings and markup undone.

`visible(text)` takes the whole raw message and returns a list of plain-text segments, one for each header block and one
for each text part or text attachment.  Defined results for odd input:

* null or empty text: no segment;
* no header block: the whole text is one body segment;
* broken base64 or quoted-printable: what can be decoded is kept;
* a multipart body that is never closed: its last part ends with the message, or where an outer part ends;
* a multipart type without a boundary line: the body counts as text;
* an inner multipart with the boundary of an outer one: the lines divide the outer one;
* attachments: base64 or other content that is valid UTF-8 without control bytes counts as text, anything else is binary
  and gives no segment beside its headers.

Of the headers only boundary parameters are left out.  Parts nest to any depth: a message is read line mark by line mark
with an explicit stack of open boundaries, once and in linear time, and nothing but that message is in memory.
"""

from __future__ import annotations

import binascii
import html
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
_FOLD = re.compile(r"\n[ \t]+")
_FIELD = re.compile(r"^(content-type|content-transfer-encoding):[ \t]*(.*)$", re.I | re.M)
_BOUNDARY = re.compile(r"boundary\s*=\s*(?:\"([^\"\n]*)\"|([^\s;]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*\"?([^\s;\"]+)", re.I)
_ENCODED_WORD = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?=(?:\s+(?==\?))?")
_ENCODED_PARAMETER = re.compile(r"\*(?:\d+\*)?=\"?([\w-]*)'[\w-]*'([^\s;\"]*)")
_MARK = re.compile(r"^--[^\n]*", re.M)
_HIDDEN = re.compile(r"<(script|style|title|template)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
_BLOCK = re.compile(r"<(?:br|/?(?:p|div|li|ul|ol|tr|td|th|table|h[1-6]|blockquote|pre|hr|body|html|head))\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>|<![^>]*>")
_BLANK = re.compile(r"\n*")
_HTML = re.compile(r"\s*<(?:html|!doc)", re.I)
_CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")


def decode_bytes(data: bytes, charset: str) -> str:
    """Text of data; a wrong or unknown charset falls back to UTF-8, then to Windows-1252 with replacement."""
    for name in (charset, "utf-8"):
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError, ValueError):
            continue
    return data.decode("cp1252", errors="replace")


def base64_bytes(text: str) -> bytes:
    """Bytes of base64 text; a last group that is cut short is dropped."""
    raw = text.encode("ascii", "ignore")
    try:
        return binascii.a2b_base64(raw)
    except binascii.Error:
        kept = re.sub(rb"[^A-Za-z0-9+/]", b"", raw)
        kept = kept[: len(kept) // 4 * 4]
        try:
            return binascii.a2b_base64(kept)
        except binascii.Error:
            return b""


def strip_html(text: str) -> str:
    """Text of an HTML part: hidden elements go, block tags end a line, other tags vanish, entities are characters."""
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub("\n", _HIDDEN.sub(" ", text)))
    return html.unescape(text) if "&" in text else text


def _encoded_word(m: re.Match) -> str:
    charset, kind, body = m.groups()
    if kind in "bB":
        data = base64_bytes(body)
    else:
        data = binascii.a2b_qp(body.replace("_", " ").encode("utf-8", "surrogatepass"))
    return decode_bytes(data, charset.partition("*")[0])


def _shown(head: str) -> str:
    """A header block (unfolded) as a reader sees it."""
    if "=?" in head:
        head = _ENCODED_WORD.sub(_encoded_word, head)
    if "*" in head and "'" in head:
        head = _ENCODED_PARAMETER.sub(lambda m: "=" + decode_bytes(unquote_to_bytes(m[2]), m[1] or "utf-8"), head)
    return _BOUNDARY.sub("", head) if "oundary" in head.lower() else head


class _Marks:
    """Open boundaries, and the lines of a text that could divide parts."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.lines = _MARK.finditer(text)
        self.now = next(self.lines, None)
        self.open: dict[str, tuple[int, bool]] = {}  # line -> (level, whether it closes)
        self.levels: list[list[str]] = []

    def push(self, boundary: str) -> bool:
        """Opens a boundary; false if it is empty or an outer part has it already."""
        line = "--" + boundary.rstrip()
        if line == "--" or line in self.open:
            return False
        mine = [x for x in (line, line + "--") if x not in self.open]
        for x in mine:
            self.open[x] = len(self.levels), x != line
        self.levels.append(mine)
        return True

    def cut(self, level: int) -> None:
        """Closes the boundaries from this level on."""
        while len(self.levels) > level:
            for x in self.levels.pop():
                del self.open[x]

    def next(self, at: int) -> tuple[int, int, int, bool] | None:
        """The first dividing line from `at` on: start, end, level, whether it closes its level."""
        while self.now is not None:
            if self.now.start() >= at:
                found = self.open.get(self.now.group().rstrip())
                if found:
                    return self.now.start(), self.now.end(), *found
            self.now = next(self.lines, None)
        return None

    def divides(self, at: int) -> bool:
        """Whether a dividing line begins at `at`."""
        mark = self.next(at) if self.open else None
        return mark is not None and mark[0] == at

    def header(self, at: int) -> tuple[str, int]:
        """Header block of the entity that begins at `at` and where its body begins; '' without a header line there.  A
        dividing line ends the block."""
        text = self.text
        if not _HEADER.match(text, at):
            return "", at + text.startswith("\n", at)
        pos = at
        while pos < len(text):
            end = text.find("\n", pos)
            end = len(text) if end < 0 else end
            if end == pos:
                return text[at : pos - 1], pos + 1
            if self.open and text.startswith("--", pos) and text[pos:end].rstrip() in self.open:
                return text[at : pos - 1], pos
            pos = end + 1
        return text[at:], len(text)


def _body(body: str, kind: str, encoding: str) -> str | None:
    """Text of a leaf; None if it is binary."""
    low = kind.lower()
    textual = low.startswith(("text/", "multipart/", "message/")) or "/" not in low
    if encoding.startswith("base64"):
        data: bytes | None = base64_bytes(body)
    elif encoding.startswith("quoted-printable"):
        data = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
    else:
        data = None
    if data is not None:
        if not textual:
            if _CONTROL.search(data):
                return None
            try:
                body = data.decode("utf-8")
            except UnicodeDecodeError:
                return None
        else:
            found = _CHARSET.search(kind)
            body = decode_bytes(data, found.group(1) if found else "utf-8")
        if "\r" in body:
            body = body.replace("\r\n", "\n").replace("\r", "\n")
    if low.startswith("text/html") or (not textual and _HTML.match(body)):
        body = strip_html(body)
    return body


def _entities(text: str) -> Iterator[tuple[str, bool]]:
    """Segments in order, and the texts of messages that were encoded within this one (marked True)."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    marks = _Marks(text)
    at, size = 0, len(text)
    while at < size:
        head, body = marks.header(at)
        kind, encoding = "text/plain", ""
        if head:
            head = _FOLD.sub(" ", head)
            for name, value in _FIELD.findall(head):
                if name[8] in "Tt" and name[9] in "yY":
                    kind = value
                else:
                    encoding = value.strip().lower()
            yield _shown(head), False
        low = kind[:16].lower()
        encoded = encoding.startswith(("base64", "quoted-printable"))
        if low.startswith("message/") and not encoded and body < size and not marks.divides(body):
            at = _BLANK.match(text, body).end()
            continue
        level = len(marks.levels)
        found = _BOUNDARY.search(kind) if low.startswith("multipart/") else None
        opened = bool(found) and marks.push(found[1] or found[2] or "")
        mark = marks.next(body)
        # the line end before a dividing line belongs to that line
        end = max(body, mark[0] - 1) if mark else size
        if opened and mark and mark[2] == level:
            end = body  # what precedes the first part isn't shown
        elif opened:
            marks.cut(level)
        if body < end:
            shown = _body(text[body:end], kind, encoding)
            if shown is not None:
                yield shown, low.startswith("message/")
        # on to the next part; what follows a closing line isn't shown
        while mark and mark[3]:
            marks.cut(mark[2])
            mark = marks.next(mark[1])
        if mark is None:
            return
        marks.cut(mark[2] + 1)
        at = mark[1] + 1


def visible(text: str | None) -> list[str]:
    """The segments of a raw message that a reader sees, in order; [] for null and empty text."""
    out: list[str] = []
    stack = [_entities(text or "")]
    while stack:
        segment, message = next(stack[-1], (None, False))
        if segment is None:
            stack.pop()
        elif message:
            stack.append(_entities(segment))
        else:
            out.append(segment)
    return out
