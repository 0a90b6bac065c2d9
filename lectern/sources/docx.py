"""DOCX files edited where their signs stand: runs are split, so that what an edit doesn't touch keeps its form."""

from __future__ import annotations

import copy
import io
import re
import zipfile
from xml.etree import ElementTree

from .files import safe_archive

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
#: Elements of a run that stand for a sign.
_SIGNS = {f"{_W}tab": "\t", f"{_W}br": "\n"}
_PARTS = re.compile(r"word/(?:header|footer)\d*\.xml")


class Package:
    """The parts of a DOCX file that hold text, and the signs of that text: (sign, run, child of the run, place in it), or None for a paragraph's end."""

    def __init__(self, data: bytes):
        if problem := safe_archive(data, ("word/document.xml",)):
            raise ValueError(problem)
        self.archive = zipfile.ZipFile(io.BytesIO(data))
        self.parts = ["word/document.xml", *sorted(n for n in self.archive.namelist() if _PARTS.fullmatch(n))]
        self.roots: dict[str, ElementTree.Element] = {}
        self.spaces: dict[str, dict[str, str]] = {}
        self.parents: dict[ElementTree.Element, ElementTree.Element] = {}
        self.signs: list[tuple | None] = []
        seen: set[str] = set()
        for part in self.parts:
            source = self.archive.read(part)
            self.spaces[part] = dict(ns for _, ns in ElementTree.iterparse(io.BytesIO(source), ("start-ns",)))
            root = self.roots[part] = ElementTree.fromstring(source)
            self.parents |= {child: parent for parent in root.iter() for child in parent}
            for p in root.iter(f"{_W}p"):
                own = self._of(p)
                text = "".join(s[0] for s in own)
                if text and (part == self.parts[0] or text not in seen):
                    seen.add(text)
                    self.signs += [*([None] if self.signs else []), *own]

    @staticmethod
    def _of(paragraph: ElementTree.Element) -> list[tuple]:
        """A paragraph's signs without the white space around them."""
        own = []
        for run in paragraph.iter(f"{_W}r"):
            for child in run:
                if child.tag == f"{_W}t":
                    own += [(c, run, child, k) for k, c in enumerate(child.text or "")]
                elif child.tag in _SIGNS:
                    own.append((_SIGNS[child.tag], run, child, 0))
        while own and own[-1][0].isspace():
            own.pop()
        first = next((k for k, s in enumerate(own) if not s[0].isspace()), len(own))
        return own[first:]

    @property
    def text(self) -> str:
        return "".join("\n" if s is None else s[0] for s in self.signs)

    def edit(self, edits: list[tuple[int, int, str]], tracked: bool, author: str, date: str) -> None:
        """Puts edits (start, end, replacement) in. They must not overlap, and none may reach over the end of a paragraph."""
        gone: dict[ElementTree.Element, dict[ElementTree.Element, set[int]]] = {}
        put: dict[ElementTree.Element, list[tuple[ElementTree.Element, int, str]]] = {}
        last = 0
        for a, b, new in sorted(edits):
            if not last <= a <= b <= len(self.signs) or None in self.signs[a:b]:
                raise ValueError("an edit overlaps another, or reaches out of its paragraph")
            last = b
            for _, run, child, k in self.signs[a:b]:
                gone.setdefault(run, {}).setdefault(child, set()).add(k)
            anchor = self.signs[a] if a < len(self.signs) and self.signs[a] else None
            behind = self.signs[a - 1] if a and self.signs[a - 1] else None
            if new:
                if not (anchor or behind):
                    raise ValueError("there is no run at the place of an insertion")
                _, run, child, k = anchor or behind
                put.setdefault(run, []).append((child, k if anchor else k + 1, new))
        for number, run in enumerate({*gone, *put}):
            self._rebuild(run, gone.get(run, {}), put.get(run, []), tracked, {f"{_W}id": str(9000 + number), f"{_W}author": author, f"{_W}date": date})

    def _rebuild(self, run, gone, put, tracked: bool, mark: dict[str, str]) -> None:
        """Takes a run's place by runs of the same form: what stays, what goes and what comes, in order."""
        form = run.find(f"{_W}rPr")
        out: list[ElementTree.Element] = []

        def add(kind: str, text: str) -> None:
            piece = ElementTree.Element(f"{_W}r")
            if form is not None:
                piece.append(copy.deepcopy(form))
            inner = ElementTree.SubElement(piece, f"{_W}delText" if kind == "del" else f"{_W}t", {_SPACE: "preserve"})
            inner.text = text
            if kind:
                wrapped = ElementTree.Element(f"{_W}{kind}", mark)
                wrapped.append(piece)
                piece = wrapped
            out.append(piece)

        for child in run:
            if child.tag == f"{_W}rPr":
                continue
            cuts, coming = gone.get(child, set()), {k: new for c, k, new in put if c is child}
            if child.tag != f"{_W}t":
                if 0 in coming:
                    add("ins" if tracked else "", coming[0])
                if 0 not in cuts:
                    piece = ElementTree.Element(f"{_W}r")
                    if form is not None:
                        piece.append(copy.deepcopy(form))
                    piece.append(child)
                    out.append(piece)
                if 1 in coming:
                    add("ins" if tracked else "", coming[1])
                continue
            text, at = child.text or "", 0
            while at <= len(text):
                if at in coming:
                    add("ins" if tracked else "", coming[at])
                if at == len(text):
                    break
                end = at + 1
                while end < len(text) and end not in coming and (end in cuts) == (at in cuts):
                    end += 1
                if at not in cuts or tracked:
                    add("del" if at in cuts else "", text[at:end])
                at = end
        parent = self.parents[run]
        place = list(parent).index(run)
        parent.remove(run)
        for k, piece in enumerate(out):
            parent.insert(place + k, piece)
            self.parents[piece] = parent

    def data(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for entry in self.archive.infolist():
                if entry.filename in self.roots:
                    archive.writestr(entry, self._written(entry.filename))
                else:
                    archive.writestr(entry, self.archive.read(entry.filename))
        return out.getvalue()

    def _written(self, part: str) -> bytes:
        """A part with all the prefixes that it declared: others may be named in values only."""
        for prefix, uri in self.spaces[part].items():
            if not re.fullmatch(r"ns\d+", prefix):
                ElementTree.register_namespace(prefix, uri)
        text = ElementTree.tostring(self.roots[part], encoding="unicode")
        head = text[: text.index(">")]
        missing = "".join(f' xmlns:{p}="{u}"' for p, u in self.spaces[part].items() if p and f'xmlns:{p}="' not in head)
        at = re.match(r"<[^\s/>]+", text).end()
        return ("<?xml version='1.0' encoding='UTF-8' standalone='yes'?>\n" + text[:at] + missing + text[at:]).encode("utf-8")


def edited_docx(data: bytes, edits: list[tuple[int, int, str]], tracked: bool = False, author: str = "lectern", date: str = "2031-01-01T00:00:00Z") -> bytes:
    """A DOCX file with edits of its text (as read by from_docx); tracked as insertions and deletions that a reader can accept or refuse."""
    package = Package(data)
    package.edit(edits, tracked, author, date)
    return package.data()
