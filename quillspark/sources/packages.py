"""Word-processing packages (.docx) as rule models.

A ``binaryFile`` scan is checked by built-in functions; each accepted file is parsed in its own task to one row
with nested arrays, which Spark then takes apart. The parser reads XML only: levels, modes, inheritance between
sections and verdicts are Spark's.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.functions import text as X
from quillspark.operators import structure
from quillspark.rules.model import FOOTERS, PARAGRAPHS, Model

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
PARAGRAPH, TABLE, RUN, TEXT, VAL, OWN, NAMED, SPACING, IND, PROPS, STYLED = (W + x for x in ("p", "tbl", "r", "t", "val", "pPr", "pStyle", "spacing", "ind", "rPr", "rStyle"))
HEADING = re.compile(r"(?i)heading\s*([1-9])")
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CORE = {"title": "title", "creator": "author", "subject": "subject", "keywords": "keywords", "lastModifiedBy": "modified_by", "created": "created", "modified": "modified"}
ALIGN = {"both": "JUSTIFY", "distribute": "JUSTIFY", "start": "LEFT", "left": "LEFT", "end": "RIGHT", "right": "RIGHT", "center": "CENTER"}
PARTS = "section int, kind string, which string, linked boolean, text string, fields array<string>"
#: What rules don't ask for: indents in points, fields with code and result, and runs of one format.
DETAILS = (
    "first_line double, left_indent double, right_indent double, outline int, field_details array<struct<kind string, instruction string, result string, simple boolean>>, "
    "formats array<struct<text string, name string, size double, bold boolean, italic boolean, underline string, color string, theme boolean>>"
)
STYLES = "style_id string, name string, type string, based_on string, is_default boolean"
#: Tables with the texts of their cells, row by row; ``parse`` gives them if it is asked for them.
TABLES = "tables array<struct<table_index int, block_index int, rows array<array<string>>>>"
ROW = f"title string, author string, subject string, keywords string, modified_by string, created string, modified string, error string, styles array<struct<{STYLES}>>, paragraphs array<struct<{PARAGRAPHS}, {DETAILS}>>, cells array<struct<table_index int, block_index int, row int, col int, text string>>, parts array<struct<{PARTS}>>"


def _val(node, tag: str, attr: str = "val") -> str | None:
    found = node.find(W + tag) if node is not None else None
    return found.get(W + attr) if found is not None else None


def _number(text: str | None, by: float) -> float | None:
    return int(text) / by if text and re.fullmatch(r"-?\d+", text) else None


def _children(node) -> dict:
    """The first child of each tag."""
    out: dict = {}
    for child in node:
        out.setdefault(child.tag, child)
    return out


class Styles:
    """Properties along the chain of a style; the nearest that is set wins, the document's defaults come last.

    What comes again and again is worked out once and kept: settings are dictionaries without what isn't set, so that nearer ones update farther ones.
    """

    def __init__(self, styles, theme):
        self.nodes = {s.get(W + "styleId"): s for s in styles.iter(W + "style")} if styles is not None else {}
        first = lambda kind: next((k for k, s in self.nodes.items() if s.get(W + "type") == kind and s.get(W + "default") in ("1", "true")), None)
        self.default = first("paragraph")
        base = styles.find(f"{W}docDefaults") if styles is not None else None
        self.base = {tag: base.find(f"{W}{tag}Default/{W}{tag}") if base is not None else None for tag in ("rPr", "pPr")}
        faces = {} if theme is None else {k: theme.find(f".//{A}{k}Font/{A}latin") for k in ("major", "minor")}
        self.faces = {k: v.get("typeface") for k, v in faces.items() if v is not None}
        self.listed = [{"style_id": k, "name": self.name(k) or None, "type": s.get(W + "type"), "based_on": _val(s, "basedOn"), "is_default": s.get(W + "default") in ("1", "true")} for k, s in self.nodes.items() if k]
        self.known: dict[str | None, tuple] = {}
        self.layouts: dict[tuple, dict] = {}
        self.looks: dict[tuple, tuple] = {}

    def chain(self, style: str | None, tag: str) -> list:
        out, seen = [], set()
        while style in self.nodes and style not in seen:
            seen.add(style)
            out.append(self.nodes[style].find(W + tag))
            style = _val(self.nodes[style], "basedOn")
        return out

    def name(self, style: str | None) -> str:
        return _val(self.nodes.get(style), "name") or ""

    def settings(self, style: str | None, tag: str) -> dict:
        """What a style's chain sets."""
        out: dict = {}
        for node in reversed(self.chain(style, tag)):
            out |= self.own(node, tag)
        return out

    def whole(self, style: str | None, tag: str) -> dict:
        """What a style's chain sets and, below it, the document's defaults."""
        return self.own(self.base[tag], tag) | self.settings(style, tag)

    def basics(self, style: str | None) -> tuple[dict, tuple, str | None, int | None]:
        """Of paragraphs of a style: their layout, the format of their runs, how the style is called, and the level of its name."""
        if (out := self.known.get(style)) is None:
            named = HEADING.fullmatch(self.name(style)) or HEADING.fullmatch(style or "")
            out = (self.layout(style, ()), self.look(style, ()), self.name(style) or style, int(named[1]) if named else None)
            if style in self.nodes:
                self.known[style] = out
        return out

    def layout(self, style: str | None, given: tuple) -> dict:
        """A paragraph's properties; ``given``: what it sets itself."""
        if (out := self.layouts.get((style, given))) is None:
            if len(self.layouts) >= LOOKS:
                self.layouts.clear()
            out = self.layouts[style, given] = laid_out(self.whole(style, "pPr") | dict(given))
        return out

    def look(self, style: str | None, given: tuple) -> tuple:
        """The format of a run; ``given``: tags and attributes of what it sets itself."""
        if (out := self.looks.get((style, given))) is None:
            if len(self.looks) >= LOOKS:
                self.looks.clear()
            found: dict = {}
            for tag, *attributes in given:
                found.setdefault(tag, dict(attributes))
            by = found[STYLED].get(VAL) if STYLED in found else None
            out = self.looks[style, given] = form(self.whole(style, "rPr") | self.settings(by, "rPr") | self.of_run(found))
        return out

    def own(self, node, tag: str) -> dict:
        """What one element sets."""
        if node is None or not len(node):
            return {}
        return self.of_run(_children(node)) if tag == "rPr" else self.of_paragraph(_children(node))

    def of_paragraph(self, found: dict) -> dict:
        out = {(tag, k): v for tag in (SPACING, IND) if tag in found for k, v in found[tag].items()}
        more = {"outline": found.get(W + "outlineLvl"), "list": found[W + "numPr"].find(W + "numId") if W + "numPr" in found else None, "jc": found.get(W + "jc")}
        return out | {k: v for k, n in more.items() if n is not None and (v := n.get(VAL)) is not None}

    def of_run(self, found: dict) -> dict:
        out = {}
        if (fonts := found.get(W + "rFonts")) is not None:
            theme = fonts.get(W + "asciiTheme") or fonts.get(W + "hAnsiTheme")
            out = {"name": self.faces.get((theme or "")[:5]) or fonts.get(W + "ascii") or fonts.get(W + "hAnsi"), "theme": theme is not None}
        for k, tag in (("bold", W + "b"), ("italic", W + "i")):
            if tag in found:
                out[k] = found[tag].get(W + "val", "true") in ("1", "true", "on")
        if (size := found.get(W + "sz")) is not None and (given := size.get(W + "val")) is not None:
            out["size"] = _number(given, 2)
        if (line := found.get(W + "u")) is not None:
            out["underline"] = line.get(W + "val")
        if (color := found.get(W + "color")) is not None:
            themed, shade = color.get(W + "themeColor"), color.get(W + "val") or "auto"
            out["color"] = f"theme:{themed}" if themed else shade if shade == "auto" else shade.upper()
        return {k: v for k, v in out.items() if v is not None or k == "size"}


#: What makes the format of a run.
FORMAT = ("name", "size", "bold", "italic", "underline", "color", "theme")


def form(props: dict) -> tuple:
    return (*[props.get(k) for k in FORMAT[:-1]], props.get("theme", False))


def laid_out(props: dict) -> dict:
    """Columns of a paragraph from what is set for it."""
    spacing, indent = (lambda attr: props.get((SPACING, W + attr))), (lambda attr: props.get((IND, W + attr)))
    hanging, outline = indent("hanging"), _number(props.get("outline"), 1)
    return {
        "is_list": props.get("list") not in (None, "0"), "align": ALIGN.get(props.get("jc") or ""), "outline": None if outline is None else int(outline),
        "line": _number(spacing("line"), 240 if (spacing("lineRule") or "auto") == "auto" else 20), "before": _number(spacing("before"), 20), "after": _number(spacing("after"), 20),
        "left_indent": _number(indent("left") or indent("start"), 20), "right_indent": _number(indent("right") or indent("end"), 20),
        "first_line": _number(indent("firstLine"), 20) if hanging is None else -(_number(hanging, 20) or 0.0),
    }


#: Ways in which paragraphs and runs are set that are kept for the styles of a package.
LOOKS = 1 << 10
#: Styles (with a theme), relationships, headers and footers of this size at most are kept for a while, the last few of each: documents of one origin share them.
KEPT_BYTES, KEPT = 1 << 18, 16


def styles_of(styles: bytes | None, theme: bytes | None) -> Styles:
    return Styles(*(None if x is None else ElementTree.fromstring(x) for x in (styles, theme)))


class Walk:
    """Rows of one part in reading order; without ``whole`` its paragraphs have no more than text, in_table and fields."""

    def __init__(self, styles: Styles, whole: bool = True):
        self.styles, self.whole, self.paragraphs, self.cells, self.tables, self.n = styles, whole, [], [], [], 0

    def container(self, node, at: tuple | None = None, box: bool = False) -> list[str]:
        """Rows of the paragraphs and tables in ``node``; the texts of its own paragraphs."""
        texts = []
        for child in node:
            if child.tag == PARAGRAPH:
                texts.append(self.paragraph(child, at, box))
            elif child.tag == TABLE:
                self.table(child, box)
            elif child.tag == W + "sdt" and child.find(W + "sdtContent") is not None:
                texts += self.container(child.find(W + "sdtContent"), at, box)
        return texts

    def table(self, node, box: bool) -> None:
        index, block, rows = len(self.tables), self.n, []
        self.tables.append({"table_index": index, "block_index": block, "rows": rows})
        self.n += 1
        for r, row in enumerate(node.findall(W + "tr")):
            texts = []
            for c, cell in enumerate(row.findall(W + "tc")):
                texts.append("\n".join(self.container(cell, (index, r, c), box)))
                self.cells.append({"table_index": index, "block_index": block, "row": r, "col": c, "text": texts[-1]})
            if texts:
                rows.append(texts)

    def paragraph(self, node, at: tuple | None, box: bool) -> str:
        block, self.n = self.n, self.n + 1
        own, style, given = node.find(OWN), None, None
        if own is not None and len(own):
            found = _children(own)
            given, style = self.styles.of_paragraph(found), found[NAMED].get(VAL) if NAMED in found else None
        style = style or self.styles.default
        layout, usual, shown, level = self.styles.basics(style)
        if given:
            layout = self.styles.layout(style, tuple(given.items()))
        found = Runs(self.styles, style, usual)
        found.walk(node)
        fields, text = found.fields, "".join([t for t, _ in found.out])
        row = {"text": text, "in_table": at is not None, "fields": [f["kind"] for f in fields]}
        if self.whole:
            formats, outline = merged(found.out), layout["outline"]
            if level is None and outline is not None and outline < 9:
                level = outline + 1
            place = f"Table {at[0] + 1}, row {at[1] + 1}, cell {at[2] + 1}" if at else f"Text box (block {block})" if box else f"Paragraph {block}"
            t, r, c = at or (None, None, None)
            row = {
                **row, **layout, "block_index": block, "location": place, "level": level, "from_textbox": box, "style": shown, "t": t, "r": r, "c": c, "field_details": fields, "formats": formats,
                "runs": [{"name": x["name"], "size": x["size"], "bold": x["bold"], "chars": len(x["text"]), "bare": len(bare)} for x in formats if (bare := x["text"].strip())],
            }
        self.paragraphs.append(row)
        for inner in found.boxes:
            self.container(inner, at, True)
        return text


class Runs:
    """Texts with their formats, closed fields in the order in which they close, and text boxes of a paragraph."""

    def __init__(self, styles: Styles, style: str | None, usual: tuple):
        self.styles, self.style, self.usual = styles, style, usual
        self.out: list[tuple[str, tuple]] = []
        self.fields: list[dict] = []
        self.boxes: list = []
        self.open: list[dict] = []

    def close(self, code: str, result: str, simple: bool) -> None:
        kind = (code.strip().lstrip('"').split() or [""])[0].upper()
        self.fields.append({"kind": kind, "instruction": code.strip(), "result": result, "simple": simple})

    def walk(self, parent) -> None:
        for child in parent:
            if child.tag == RUN or (tag := child.tag.removeprefix(W)) == "r":
                self.run(child)
            elif tag in ("hyperlink", "ins", "smartTag", "customXml"):
                self.walk(child)
            elif tag == "fldSimple":
                before = len(self.out)
                self.walk(child)
                self.close(child.get(W + "instr", ""), "".join([t for t, _ in self.out[before:]]), True)

    def run(self, node) -> None:
        own, text, open_fields = None, "", self.open
        for child in node:
            tag, more = child.tag, ""
            if tag == PROPS:
                own = child if own is None else own
                continue
            if tag == TEXT or (tag := tag.removeprefix(W)) == "t":
                more = child.text or ""
            elif tag in ("tab", "br", "cr", "noBreakHyphen"):
                more = {"tab": "\t", "noBreakHyphen": "-"}.get(tag, "\n")
            elif tag == "instrText" and open_fields:
                open_fields[-1]["code"] += child.text or ""
            elif tag == "fldChar":
                step = child.get(W + "fldCharType")
                if step == "begin":
                    open_fields.append({"code": "", "result": None})
                elif open_fields and step == "separate":
                    open_fields[-1]["result"] = ""
                elif open_fields and step == "end":
                    last = open_fields.pop()
                    self.close(last["code"], last["result"] or "", False)
            elif tag in ("drawing", "pict", "object"):
                self.boxes.extend(child.iter(W + "txbxContent"))
            text += more
            if open_fields and more:
                shown = [f for f in open_fields if f["result"] is not None]
                if shown:
                    shown[-1]["result"] += more
        look = self.usual if own is None or not len(own) else self.styles.look(self.style, tuple([(c.tag, *c.items()) for c in own]))
        self.out.append((text, look))


def merged(runs: list[tuple[str, tuple]]) -> list[dict]:
    """Neighbouring runs of one format as one; runs without text are left out."""
    out: list[dict] = []
    last = None
    for text, look in runs:
        if text and look == last:
            out[-1]["text"] += text
        elif text:
            out.append(dict(zip(FORMAT, last := look, strict=True), text=text))
    return out


def part_text(content: bytes, styles: Styles) -> tuple[str, list[str]]:
    """Text and fields of a header or footer: its paragraphs before those of its tables."""
    inner = Walk(styles, False)
    inner.container(ElementTree.fromstring(content))
    lines = sorted(inner.paragraphs, key=lambda p: p["in_table"])
    return "\n".join([p["text"] for p in lines]), [f for p in lines for f in p["fields"]]


def linked(links: bytes | None) -> dict[str | None, str | None]:
    """The targets of a document's relationships by their ids."""
    return {} if links is None else {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(links)}


class Seen:
    """What parts came to that several packages of a task hold."""

    def __init__(self):
        self.styles, self.links, self.text = lru_cache(KEPT)(styles_of), lru_cache(KEPT)(linked), lru_cache(KEPT)(part_text)

    def get(self, what: str, *given):
        small = sum(len(x) for x in given if isinstance(x, bytes)) <= KEPT_BYTES
        known = getattr(self, what)
        return (known if small else known.__wrapped__)(*given)


def parse_package(content: bytes, whole: bool = True, seen: Seen | None = None) -> dict:
    """Paragraphs, cells and header parts of one package; ``error`` if it can't be read. Without ``whole`` paragraphs are as in ``Walk``."""
    seen = seen or Seen()
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            read = lambda name: z.read(name) if name in names else None
            load = lambda name: ElementTree.fromstring(z.read(name)) if name in names else None
            body = load("word/document.xml").find(W + "body")
            styles = seen.get("styles", read("word/styles.xml"), read("word/theme/theme1.xml"))
            walk = Walk(styles, whole)
            walk.container(body)
            core = load("docProps/core.xml")
            row = {CORE[n]: e.text or None for e in (core if core is not None else ()) if (n := e.tag.rpartition("}")[2]) in CORE}
            targets = seen.get("links", read("word/_rels/document.xml.rels"))
            parts = []
            for i, section in enumerate(body.iter(W + "sectPr")):
                for kind in ("header", "footer"):
                    given = {e.get(W + "type", "default"): targets.get(e.get(REL)) for e in section.findall(f"{W}{kind}Reference")}
                    for which in ("default", "first", "even"):
                        part = read(f"word/{given[which]}".replace("word//", "")) if given.get(which) else None
                        text, fields = ("", []) if part is None else seen.get("text", part, styles)
                        parts.append({"section": i, "kind": kind, "which": which, "linked": part is None, "text": text, "fields": fields})
        return row | {"styles": styles.listed, "paragraphs": walk.paragraphs, "cells": walk.cells, "tables": walk.tables, "parts": parts, "error": None}
    except Exception as e:  # whatever is wrong with a file is reported with its row
        return {"error": f"{type(e).__name__}: {e}"[:500], "styles": [], "paragraphs": [], "cells": [], "tables": [], "parts": []}


#: Nested rows of a batch, about.
AT_ONCE = 1 << 10


def _parse(schema: pa.Schema):
    whole = "paragraphs" in schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, seen = [], 0, Seen()
        for batch in batches:
            for doc, name, content in zip(*(batch.column(c) for c in ("doc_id", "filename", "content")), strict=True):
                rows.append({"doc_id": doc.as_py(), "filename": name.as_py()} | parse_package(content.as_py(), whole, seen))
                held += 1 + sum(len(rows[-1][k]) for k in ("styles", "paragraphs", "cells", "parts"))
                if held >= AT_ONCE:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: doc_id (the safe stem), filename, path, modificationTime, length, content, code (null: taken)."""
    return named(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def named(raw: DataFrame) -> DataFrame:
    filename = F.url_decode(F.replace(F.regexp_extract("path", r"[^/\\]*$", 0), F.lit("+"), F.lit("%2B")))
    return raw.withColumn("filename", filename).withColumns({"doc_id": X.safe_stem(F.col("filename")), "code": X.reject_code(F.col("path"), F.col("length"), F.col("content"))})


def rejected(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """doc_id, code, detail of files that aren't taken: by their name, size or first bytes, or as they can't be read."""
    words = F.when(F.col("code") == 415, "not a .docx name").when(F.col("code") == 413, "too large").otherwise("not a zip package")
    early = files.filter("code is not null").select("doc_id", "code", words.alias("detail"))
    return early.unionByName(parsed.filter("error is not null").select("doc_id", F.lit(422).alias("code"), F.col("error").alias("detail")))


def parse(files: DataFrame, row: str = ROW) -> DataFrame:
    """A row per accepted file with its nested content; of files with the same doc_id the newest.

    ``row``: the columns that are wanted; columns and nested fields of ROW may be left out, TABLES may be added. Whatever they
    are, all parts of a package are read, so that its error is the same. Each file is read once: it goes to its doc_id with its content,
    and every task sends the newest of a doc_id alone.
    """
    taken = files.filter("code is null").select("doc_id", "filename", "path", "modificationTime", "content")
    newest = structure.latest(taken, ["doc_id"], F.col("modificationTime").desc(), F.col("path").desc()).select("doc_id", "filename", "content")
    schema = T.StructType.fromDDL(f"doc_id string, filename string, {row}")
    return newest.mapInArrow(_parse(to_arrow_schema(schema)), schema)


def package_styles(parsed: DataFrame) -> DataFrame:
    """The styles of every package: doc_id, style_id, name, type, based_on, is_default."""
    return parsed.filter("error is null").select("doc_id", F.explode("styles").alias("s")).select("doc_id", "s.*")


def core_dates(parsed: DataFrame) -> DataFrame:
    """doc_id, created, modified of the core properties; null where a package has none or no date."""
    return parsed.filter("error is null").select("doc_id", *[F.try_to_timestamp(c).alias(c) for c in ("created", "modified")])


def package_model(parsed: DataFrame) -> Model:
    """The model of parsed packages; levels of documents that declare none are inferred, linked parts inherited."""
    good = parsed.filter("error is null")
    docs = good.select("doc_id", "filename", "title", "author", "subject", "keywords", "modified_by")
    paragraphs = good.select("doc_id", F.explode("paragraphs").alias("p")).select("doc_id", "p.*")
    runs = paragraphs.select("doc_id", "block_index", F.posexplode("runs").alias("ord", "run")).select("doc_id", "block_index", "ord", "run.size", "run.bold", "run.chars", "run.bare")
    guessed = structure.infer_heading_levels(paragraphs.withColumn("declared", F.col("level")), runs)
    paragraphs = paragraphs.join(guessed, ["doc_id", "block_index"], "left").withColumn("level", F.coalesce("level", "inferred")).drop("inferred")
    cells = good.select("doc_id", F.explode("cells").alias("c")).select("doc_id", "c.*")
    parts = good.select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.*")
    return Model(docs, paragraphs, cells, inherit_parts(parts))


def inherit_parts(parts: DataFrame) -> DataFrame:
    """Headers and footers that are in force: a linked one shows what the previous section shows for its kind of page, else that section's default one.

    The sections of a document are few; they are gone through in order within one row per document and kind.
    """
    shown = "struct<text:string,fields:array<string>>"
    names = ("default", "first", "even")
    rows = parts.groupBy("doc_id", "kind", "section").agg(*[F.max(F.when((F.col("which") == w) & ~F.col("linked"), F.struct("text", "fields"))).alias(w) for w in names])
    sections = F.array_sort(F.collect_list(F.struct("section", *names)))
    start = F.struct(*[F.lit(None).cast(shown).alias(w) for w in names], F.array().cast(f"array<struct<section:int,default:{shown},first:{shown},even:{shown}>>").alias("out"))

    def step(before, own):
        now = [F.coalesce(own[w], before[w], before["default"]).alias(w) for w in names]
        return F.struct(*now, F.concat(before["out"], F.array(F.struct(own["section"].alias("section"), *now))).alias("out"))

    rows = rows.groupBy("doc_id", "kind").agg(F.aggregate(sections, start, step)["out"].alias("s")).select("doc_id", "kind", F.explode("s").alias("s"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("w"), F.lit(w).alias("which"), F.col(f"s.{w}").alias("own")) for i, w in enumerate(names)]))
    rows = rows.select("doc_id", "kind", F.col("s.section").alias("section"), each.alias("x")).select("doc_id", "kind", "section", "x.*").filter("own is not null")
    rows = rows.withColumns({"ord": (F.col("section") * 3 + F.col("w")).cast("int"), "text": F.col("own.text"), "fields": F.col("own.fields")})
    label = F.concat(F.initcap("kind"), F.when(F.col("which") == "default", "").otherwise(F.concat(F.lit(" ("), "which", F.lit(" page)"))), F.lit(", section "), (F.col("section") + 1).cast("string"))
    columns = [f.strip().split()[0] for f in FOOTERS.split(",")]
    return rows.withColumn("location", label).select("doc_id", *columns)
