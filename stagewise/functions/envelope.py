"""XML envelope around prompts, built from string expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters escaped in attribute values, in order of replacement.
ATTRIBUTE_ESCAPES = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&#34;"),
    ("'", "&#39;"),
    ("\t", "&#x9;"),
    ("\n", "&#xA;"),
    ("\r", "&#xD;"),
]


def _column(value: Column | str | None) -> Column | None:
    return F.lit(value) if isinstance(value, str) else value


def escape_attribute(value: Column) -> Column:
    """Attribute text with the reserved characters replaced."""
    for raw, entity in ATTRIBUTE_ESCAPES:
        value = F.replace(value, F.lit(raw), F.lit(entity))
    return value


def cdata(content: Column) -> Column:
    """CDATA section with one blank inside each end; an end mark in the text is split over two sections."""
    guarded = F.replace(content, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(F.lit("<![CDATA[ "), guarded, F.lit(" ]]>"))


@dataclass(frozen=True)
class Node:
    """One element. Text hides children; a null child column leaves the child out of that row."""

    tag: str
    content: Column | str | None = None
    name: Column | str | None = None
    description: Column | str | None = None
    content_type: Column | str | None = None
    children: tuple["Node", ...] = field(default_factory=tuple)
    present: Column | None = None

    def to_column(self, depth: int = 0) -> Column:
        """Element text; nested elements start on their own line, indented by one blank per level."""
        parts: list[Column] = [F.lit("<" + self.tag)]
        for label, value in (
            ("name", self.name),
            ("description", self.description),
            ("contentType", self.content_type),
        ):
            column = _column(value)
            if column is not None:
                escaped = F.nullif(escape_attribute(column), F.lit(""))
                parts.append(F.coalesce(F.concat(F.lit(f' {label}="'), escaped, F.lit('"')), F.lit("")))
        parts.append(F.lit(">"))

        inner = self._children_column(depth)
        content = _column(self.content)
        if content is not None:
            # An empty text turns null, so the concatenation does too and the children show.
            inner = F.coalesce(cdata(F.nullif(content, F.lit(""))), inner)
        return F.concat(*parts, inner, F.lit(f"</{self.tag}>"))

    def _children_column(self, depth: int) -> Column:
        if not self.children:
            return F.lit("")
        texts = []
        for child in self.children:
            text = F.concat(F.lit("\n" + " " * (depth + 1)), child.to_column(depth + 1))
            texts.append(text if child.present is None else F.when(child.present, text).otherwise(F.lit("")))
        closing: Column = F.lit("\n" + " " * depth)
        flags = [child.present for child in self.children if child.present is not None]
        if len(flags) == len(self.children):
            closing = F.when(reduce(lambda a, b: a | b, flags), closing).otherwise(F.lit(""))
        return F.concat(*texts, closing)
