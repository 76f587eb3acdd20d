"""Text of .docx and .odt packages (S8): one pass over the XML events, whatever the size of the part.

Both formats come out the same way. A paragraph is a line; tabs and line breaks
inside it stay (``\\t``, ``\\n``); paragraphs of a text box or a note follow the
paragraph that holds them, each once. A table row is one line, its cells
separated by tabs and the lines within a cell by spaces. Deleted, hidden
(``w:vanish``) and commenting text, field instructions and the fallback copy of
a drawing are left out.

A part that unpacks to more than ``max_bytes`` is an error of its file, raised
before more than that has been unpacked.
"""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass, field
from xml.parsers import expat

MAX_BYTES = 256 << 20
_BLANKS = re.compile("[ \t\r\n]+")


@dataclass
class _Paragraph:
    pieces: list[str] = field(default_factory=list)
    after: list[str] = field(default_factory=list)  # lines of boxes and notes held by it


@dataclass
class _Cells:
    cells: list[list[str]] = field(default_factory=list)


def _dropped(text: str) -> None:
    pass


class _Names(dict):
    """Local names by "address name", as the parser gives them: tags go by theirs, whatever prefix a file chose."""

    def __missing__(self, name: str) -> str:
        self[name] = local = name.rpartition(" ")[2]
        return local


def _attribute(attrs: dict[str, str], name: str, otherwise: str) -> str:
    return {k.rpartition(" ")[2]: v for k, v in attrs.items()}.get(name, otherwise) if attrs else otherwise


class _Lines:
    """Paragraphs and rows that are open, innermost last; a finished one gives its lines to what holds it."""

    def __init__(self):
        self.lines: list[str] = []
        self.open: list[_Paragraph | _Cells] = []
        #: Takes a piece of the innermost one's text if that is a paragraph, and drops it otherwise.
        self.put = _dropped

    def begin(self, item: _Paragraph | _Cells) -> None:
        self.open.append(item)
        self.put = item.pieces.append if isinstance(item, _Paragraph) else _dropped

    def give(self, lines: list[str]) -> None:
        holder = self.open[-1] if self.open else None
        if holder is None:
            self.lines += lines
        elif isinstance(holder, _Paragraph):
            holder.after += lines
        else:
            if not holder.cells:
                holder.cells.append([])
            holder.cells[-1] += lines

    def blank_before(self) -> bool:
        """Whether a blank here would follow another one or begin the paragraph."""
        if self.open and isinstance(self.open[-1], _Paragraph):
            last = next((p for p in reversed(self.open[-1].pieces) if p), "\n")
            return last[-1] in " \n"
        return True

    def close(self) -> None:
        done = self.open.pop()
        holder = self.open[-1] if self.open else None
        self.put = holder.pieces.append if isinstance(holder, _Paragraph) else _dropped
        if isinstance(done, _Paragraph):
            self.give(["".join(done.pieces), *done.after])
        else:
            self.give(["\t".join(" ".join(x for line in c if (x := _BLANKS.sub(" ", line).strip(" "))) for c in done.cells)])


class _Docx:
    """Events of word/document.xml."""

    SKIPPED = {"Fallback", "delText", "instrText", "del", "moveFrom", "rPr", "pPr", "sectPr", "tblPr", "tblGrid", "trPr", "tcPr"}
    CHARACTERS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}

    def __init__(self):
        self.out, self.names = _Lines(), _Names()
        self.skip, self.in_text, self.hidden, self.props = 0, 0, False, False

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        name = self.names[tag]
        if self.skip:
            self.skip += 1
            if name == "vanish" and self.props and _on(attrs):
                self.hidden = True
        elif name in self.SKIPPED:
            self.skip = 1
            self.props = name == "rPr"
        elif name == "r":
            self.hidden = False
        elif name == "p":
            self.out.begin(_Paragraph())
        elif name == "tr":
            self.out.begin(_Cells())
        elif name == "tc":
            if self.out.open and isinstance(self.out.open[-1], _Cells):
                self.out.open[-1].cells.append([])
        elif name == "t":
            self.in_text += 1
        elif name in self.CHARACTERS and not self.hidden:
            self.out.put(self.CHARACTERS[name])

    def end(self, tag: str) -> None:
        if self.skip:
            self.skip -= 1
            return
        name = self.names[tag]
        if name in ("p", "tr"):
            self.out.close()
        elif name == "t":
            self.in_text -= 1

    def text(self, data: str) -> None:
        if self.in_text and not self.skip and not self.hidden:
            self.out.put(data)


def _on(attrs: dict[str, str]) -> bool:
    return _attribute(attrs, "val", "true") not in ("0", "false", "off")


class _Odt:
    """Events of content.xml; runs of white space in the XML count as one space."""

    SKIPPED = {"annotation", "tracked-changes", "automatic-styles", "font-face-decls", "scripts", "note-citation", "ruby-text",
               "change", "forms", "title", "desc", "binary-data"}
    CLOSING = {"p", "h", "table-row"}

    def __init__(self):
        self.out, self.names, self.skip = _Lines(), _Names(), 0

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        name = self.names[tag]
        if self.skip:
            self.skip += 1
        elif name == "s":  # first: the most frequent by far
            count = _attribute(attrs, "c", "1") if attrs else "1"
            self.out.put(" " if count == "1" else " " * min(int(count) if count.isdigit() else 1, 10_000))
        elif name in self.SKIPPED:
            self.skip = 1
        elif name in ("p", "h"):
            self.out.begin(_Paragraph())
        elif name == "table-row":
            self.out.begin(_Cells())
        elif name == "table-cell":
            if self.out.open and isinstance(self.out.open[-1], _Cells):
                self.out.open[-1].cells.append([])
        elif name == "tab":
            self.out.put("\t")
        elif name == "line-break":
            self.out.put("\n")

    def end(self, tag: str) -> None:
        if self.skip:
            self.skip -= 1
        elif self.names[tag] in self.CLOSING:
            self.out.close()

    def text(self, data: str) -> None:
        if self.skip:
            return
        if " " in data or "\n" in data or "\t" in data or "\r" in data:
            data = _BLANKS.sub(" ", data)
            if data[0] == " " and self.out.blank_before():
                data = data[1:]
        self.out.put(data)


def _read(data: bytes, member: str, events: _Docx | _Odt, max_bytes: int) -> str:
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler = events.start
    parser.EndElementHandler = events.end
    parser.CharacterDataHandler = events.text
    seen = 0
    with zipfile.ZipFile(io.BytesIO(data)) as z, z.open(member) as part:
        while block := part.read(1 << 16):
            if (seen := seen + len(block)) > max_bytes:
                raise ValueError(f"{member} unpacks to more than {max_bytes} bytes")
            parser.Parse(block)
        parser.Parse(b"", True)
    return "\n".join(events.out.lines)


def docx_text(data: bytes, max_bytes: int = MAX_BYTES) -> str:
    return _read(data, "word/document.xml", _Docx(), max_bytes)


def odt_text(data: bytes, max_bytes: int = MAX_BYTES) -> str:
    return _read(data, "content.xml", _Odt(), max_bytes)
