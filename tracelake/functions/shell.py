"""Command lines brought to one form, as column expressions that stay linear on long texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scan import let, none, scan

#: First words that stand for other commands.
ALIASES = {"ll": "ls -l", "la": "ls -a", "l": "ls", "please": "sudo"}
#: What ends a word of a command line.
_EDGE = r"\s;&|"
_DELETE = rf"(?<![^{_EDGE}])--?delete(?![^{_EDGE}])"


def unescape(text: Column) -> Column:
    r"""``\uXXXX``, ``\xXX``, ``\n``, ``\t`` and ``\\`` as the characters that they mean, in one pass."""
    parts = F.regexp_extract_all(text, F.lit(r"\\[uU](?![dD][89a-fA-F])[0-9a-fA-F]{4}|\\[xX][0-9a-fA-F]{2}|\\[nt\\]|[^\\]++|\\"), F.lit(0))

    def meant(p: Column) -> Column:
        number = F.lpad(F.substring(p, 3, 4), 4, "0")
        coded = p.rlike(r"^\\[uUxX][0-9a-fA-F]")
        return (
            F.when(~p.startswith("\\"), p)
            .when(coded, F.decode(F.unhex(number), "UTF-16BE"))
            .when(p == "\\n", "\n").when(p == "\\t", "\t").when(p == "\\\\", "\\").otherwise(p)
        )

    return F.when(text.contains("\\"), F.array_join(F.transform(parts, meant), "")).otherwise(text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain_path(path: Column) -> Column:
    """A path without ``.``, ``..`` and doubled slashes, by its text alone."""
    parts = F.filter(F.reverse(F.split(path, "/", -1)), lambda c: (c != "") & (c != "."))

    def step(pending: Column, c: Column) -> tuple[Column, Column]:
        up, gone = c == "..", pending > 0
        return F.when(up, pending + 1).when(gone, pending - 1).otherwise(pending), F.when(up | gone, none("string")).otherwise(F.array(c))

    def joined(parts: Column, kept: Column) -> Column:
        ups = F.size(F.filter(parts, lambda c: c == ".."))
        left = 2 * ups - F.size(parts) + F.size(kept)  # those that found nothing to take away
        rest = F.array_join(F.concat(F.array_repeat(F.lit(".."), left), kept), "/")
        return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(kept, "/"))).when(rest == "", ".").otherwise(rest)

    return let(parts, lambda p: let(F.reverse(scan(p, F.lit(0), step, "string")), lambda kept: joined(p, kept)))


def expand(text: Column) -> Column:
    """``$NAME`` and ``${NAME}`` by the assignments ``NAME=value`` in the same text, one level deep."""
    assigned = r"(?<![^ \t\n;&|])([A-Za-z_][A-Za-z0-9_]*+)=([^;|&]*+)"
    parts = F.regexp_extract_all(text, F.lit(r"\$\{[^}]*+\}|\$[A-Za-z_][A-Za-z0-9_]*+|[^$]++|\$"), F.lit(0))
    names, values = (F.regexp_extract_all(text, F.lit(assigned), F.lit(g)) for g in (1, 2))
    pairs = F.array_sort(F.transform(F.arrays_zip(names.alias("k"), values.alias("v")), lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), F.trim(p["v"]).alias("v"))))

    def known(pairs: Column) -> Column:
        # Of several assignments to a name the last one counts.
        last = F.filter(pairs, lambda p, i: ~F.coalesce(F.get(pairs, i + 1)["k"] == p["k"], F.lit(False)))
        return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))

    def filled(table: Column) -> Column:
        value = lambda p: F.coalesce(F.try_element_at(table, F.regexp_replace(p, r"^\$\{?|\}$", "")), p)
        return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("$"), value(p)).otherwise(p)), "")

    return F.when(text.contains("$") & text.contains("="), let(let(pairs, known), filled)).otherwise(text)


def fold_aliases(command: Column) -> Column:
    """Aliases of first words, ``/bin/`` before commands, and ``find … -delete`` as ``rm -rf …``."""
    first = reduce(lambda c, a: F.regexp_replace(c, rf"^\s*{a[0]}(?=\s|$)", a[1]), ALIASES.items(), command)
    bare = F.regexp_replace(first, r"(?<![^\s;|&()])/bin/([\w.-]*+)", "$1")

    def folded(p: Column, i: Column) -> Column:
        middle = F.trim(F.regexp_extract(p, rf"(?s)^(.*?){_DELETE}", 1))
        tail = F.regexp_extract(p, rf"(?s){_DELETE}(.*)$", 1)
        new = F.concat(F.lit("rm -rf"), F.when(middle != "", F.concat(F.lit(" "), middle)).otherwise(""), tail)
        return F.when(i == 0, p).when(p.rlike(_DELETE), new).otherwise(F.concat(F.lit("find"), p))

    def whole(bare: Column) -> Column:
        pieces = F.split(bare, rf"(?<![^{_EDGE}])find(?=[{_EDGE}]|$)", -1)
        return F.when(bare.contains("delete") & bare.contains("find"), F.array_join(F.transform(pieces, folded), "")).otherwise(bare)

    return let(bare, whole)


def canonical(args: Column) -> Column:
    """Unescaped, on one line, without ``/../``, with variables and aliases put in."""
    flat = let(args, lambda a: collapse(unescape(a)))
    paths = let(flat, lambda f: F.when(f.contains("/../"), plain_path(f)).otherwise(f))
    return let(let(paths, expand), fold_aliases)


def chain(command: Column) -> Column:
    """Commands between ``;``, ``&&``, ``||`` and ``|``; quoted separators do not cut."""
    quoted = r"'(?:[^'\\]|\\.)*+'?|\"(?:[^\"\\]|\\.)*+\"?"
    piece = rf"(?s)(?:[^;|&'\"]++|{quoted}|(?<!&)&(?!&))++"
    found = F.transform(F.regexp_extract_all(command, F.lit(piece), F.lit(0)), lambda p: F.trim(p))
    return F.filter(found, lambda p: p != "")


def path_words(command: Column) -> Column:
    """Words with a slash or a leading ``~``, without quotes around them, as plain paths in small letters."""
    words = F.filter(F.split(command, r"\s+", -1), lambda w: w.contains("/") | w.startswith("~"))
    odd = r"//|/\.{1,2}(?:/|$)|^\.{1,2}/|/$"

    def plain(w: Column) -> Column:
        return F.lower(let(F.trim(w, F.lit("\"',;")), lambda bare: F.when(bare.rlike(odd), plain_path(bare)).otherwise(bare)))

    return F.transform(words, plain)
