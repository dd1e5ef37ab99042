"""RDF terms as columns: prefixes, templates, N-Triples text."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies in use.
PREFIXES = {
    "ex": "http://kg.projet.fr/ontology#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "schema": "https://schema.org/",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "owl": "http://www.w3.org/2002/07/owl#",
}
RDF_TYPE = PREFIXES["rdf"] + "type"
SAME_AS = PREFIXES["owl"] + "sameAs"
XSD_DATE = PREFIXES["xsd"] + "date"
XSD_DECIMAL = PREFIXES["xsd"] + "decimal"

_REFERENCE = re.compile(r"\$\(([^)]+)\)")
_SEPARATOR = "\x1f"
# Subject, predicate, and the rest of the line. No pattern repeats a group, so a literal of any length
# is read without recursion.
_HEAD = r"(?s)^\s*(?:<([^<>\s]*)>|(_:\S+))\s+<([^<>\s]*)>\s+(.*)$"
_NODE = r"^(?:<([^<>\s]*)>|(_:[^\s.]+))\s*\.\s*(?:#.*)?$"
# A literal from its first quote to the next that is not escaped; possessive, so its length costs no stack.
_LITERAL = r'(?s)^"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:\^\^<([^<>\s"]*)>|@([A-Za-z0-9-]+))?\s*\.\s*(?:#.*)?$'


def expand_prefix(term: str, prefixes: Mapping[str, str] = PREFIXES) -> str:
    head, colon, tail = term.partition(":")
    return prefixes[head] + tail if colon and head in prefixes and not tail.startswith("//") else term


def expand_prefix_column(term: Column, prefixes: Mapping[str, str] = PREFIXES) -> Column:
    """As ``expand_prefix``, for data; a term without a known prefix stays as it is."""
    lookup = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    head = F.substring_index(term, ":", 1)
    known = F.try_element_at(lookup, head)
    tail = F.substring(term, F.length(head) + 2, F.length(term))
    return F.when(known.isNotNull() & term.contains(":") & ~tail.startswith("//"), F.concat(known, tail)).otherwise(term)


def percent_encode(c: Column) -> Column:
    """Everything but letters, digits and ``-._~`` as %XX of its UTF-8 bytes.

    ``url_encode`` follows the form rules; its three differences are put right.
    """
    form = F.url_encode(c.cast("string"))
    for have, want in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(have), F.lit(want))
    return form


def template_references(template: str) -> list[str]:
    return _REFERENCE.findall(template)


def template_prefix(template: str) -> str:
    """The constant text before the first reference."""
    return _REFERENCE.split(template, maxsplit=1)[0]


def _fill(template: str, reference) -> Column:
    parts = _REFERENCE.split(template)
    columns = [reference(F.col(x)) if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x]
    return columns[0] if len(columns) == 1 else F.concat(*columns)


def iri_from_template(template: str) -> Column:
    """``$(column)`` references are percent-encoded; a null reference makes the whole term null.

    A template that is one reference and nothing else holds whole IRIs, which stay as they are.
    """
    parts = _REFERENCE.split(template)
    if len(parts) == 3 and not parts[0] and not parts[2]:
        return F.col(parts[1]).cast("string")
    return _fill(template, percent_encode)


def text_from_template(template: str) -> Column:
    return _fill(template, lambda c: c.cast("string"))


def escape_literal(c: Column) -> Column:
    for have, want in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(have), F.lit(want))
    return c


def unescape_literal(c: Column) -> Column:
    """Undo N-Triples escapes, including ``\\uXXXX`` and ``\\UXXXXXXXX``."""

    def code_points(part: Column, marker: str, digits: int) -> Column:
        def joined(pieces: Column) -> Column:
            decoded = F.transform(
                F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
                lambda x: F.concat(
                    F.decode(F.unhex(F.lpad(F.substring(x, 1, digits), 8, "0")), "UTF-32"),
                    F.substring(x, digits + 1, F.length(x)),
                ),
            )
            return F.concat(F.element_at(pieces, 1), F.array_join(decoded, ""))

        return once(part, lambda x: F.when(x.contains(marker), once(F.split(x, "\\" + marker), joined)).otherwise(x))

    def simple(part: Column) -> Column:
        for have, want in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
            part = F.replace(part, F.lit(have), F.lit(want))
        return code_points(code_points(part, r"\u", 4), r"\U", 8)

    # An escaped backslash can only stand between parts, so each part is free of them.
    whole = F.array_join(F.transform(F.split(c, r"\\\\"), simple), "\\")
    return F.when(c.contains("\\"), whole).otherwise(c)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it; for expressions as long as a text."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def node_text(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def triple_line(s: Column, p: Column, o: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    literal = F.concat(
        F.lit('"'), escape_literal(o), F.lit('"'),
        F.when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">")))
        .when(lang.isNotNull(), F.concat(F.lit("@"), lang))
        .otherwise(F.lit("")),
    )
    return F.concat_ws(" ", node_text(s), node_text(p), F.when(kind == "literal", literal).otherwise(node_text(o)), F.lit("."))


def parse_triple_line(line: Column) -> Column:
    """Struct ``s, p, o, o_kind, o_datatype, o_lang`` of an N-Triples line; null where malformed."""
    none = F.lit(None).cast("string")

    def cut(c: Column, pattern: str, groups: Sequence[int]) -> Column:
        """The groups of a line that matches; any other line stays one piece."""
        return F.split(F.regexp_replace(c, pattern, _SEPARATOR.join(f"${k}" for k in groups)), _SEPARATOR, len(groups))

    def triple(part: Column, kind: str, o: Column, datatype: Column, lang: Column) -> Column:
        return F.struct(
            F.when(F.get(part, F.lit(1)) != "", F.get(part, F.lit(1))).otherwise(F.get(part, F.lit(0))).alias("s"),
            F.get(part, F.lit(2)).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), datatype.alias("o_datatype"), lang.alias("o_lang"),
        )

    def literal(part: Column, tail: Column) -> Column:
        """``tail`` holds datatype, language and text, or the rest as it is, from its quote on."""
        optional = lambda k: F.nullif(F.get(tail, F.lit(k)), F.lit(""))
        text = once(F.get(tail, F.lit(2)), unescape_literal)
        return F.when(~F.get(tail, F.lit(0)).startswith('"'), triple(part, "literal", text, optional(0), optional(1)))

    def node(part: Column, rest: Column) -> Column:
        iri, blank = (F.regexp_extract(rest, _NODE, k) for k in (1, 2))
        return F.when(rest.rlike(_NODE), triple(part, "iri", F.when(blank != "", blank).otherwise(iri), none, none))

    def whole(part: Column) -> Column:
        rest = F.get(part, F.lit(3))
        found = F.when(rest.startswith('"'), once(cut(rest, _LITERAL, (2, 3, 1)), lambda x: literal(part, x))).otherwise(node(part, rest))
        return F.when(F.size(part) == 4, found)

    return once(cut(line, _HEAD, (1, 2, 3, 4)), whole)


def local_name(c: Column) -> Column:
    """What follows the last ``#``, then the last ``/``."""
    return F.substring_index(F.substring_index(c, "#", -1), "/", -1)
