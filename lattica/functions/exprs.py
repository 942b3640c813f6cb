"""Column expressions over paths, names and C declarations; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of symbol kinds in lists, and languages of file name extensions.
KIND_RANKS = {"function": 0, "method": 0, "macro": 1, "struct": 1, "class": 1, "typedef": 1, "enum": 1, "union": 1, "variable": 2, "enumerator": 2, "field": 3, "prototype": 4}
OTHER_RANK = 5
KINDS = ("function", "prototype", "method", "variable", "field", "struct", "class", "union", "enum", "enumerator", "typedef", "macro", "namespace")
EXTENSIONS = {"c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "c++": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "inl": "cpp", "ipp": "cpp"}
QUALIFIERS = ("const", "volatile", "static", "extern", "inline", "register", "mutable", "constexpr", "virtual", "explicit", "friend", "typename", "struct", "class", "union", "enum", "unsigned", "signed", "restrict", "thread_local", "auto")

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def kind_rank(kind: Column) -> Column:
    out = None
    for rank in sorted(set(KIND_RANKS.values())):
        test = kind.isin([k for k, r in KIND_RANKS.items() if r == rank])
        out = F.when(test, rank) if out is None else out.when(test, rank)
    return out.otherwise(OTHER_RANK)


def normalize_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(normalize_path(path), "/", -1)


def dir_of(path: Column, root: str = "") -> Column:
    """The directory with the root in front taken off, whatever its case; '/' where nothing is left."""
    p = normalize_path(path)
    d = F.regexp_replace(p, "/?[^/]*$", "")
    root = root.replace("\\", "/").rstrip("/")
    cut = F.when(F.lower(F.substring(d, 1, len(root))) == root.lower(), F.substring(d, len(root) + 1, 1 << 20)).otherwise(d) if root else d
    cut = F.regexp_replace(cut, "^/+", "") if root else cut
    return F.when(cut == "", "/").otherwise(cut)


def short_file(path: Column) -> Column:
    """The last two segments."""
    return F.substring_index(normalize_path(path), "/", -2)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(normalize_path(path), r"\.([^./]+)$", 1))


def lang_for_path(path: Column, header: str = "cpp") -> Column:
    """'c' or 'cpp' by extension; null for other files."""
    e = extension(path)
    out = F.when(e == "h", header)
    for lang in ("c", "cpp"):
        out = out.when(e.isin([k for k, v in EXTENSIONS.items() if v == lang]), lang)
    return out


def normalize_include(raw: Column) -> Column:
    """An include as written, without quotes, with '/' and without leading './' and '../'."""
    return F.regexp_replace(normalize_path(F.regexp_replace(F.trim(raw), '^[<"]|[>"]$', "")), r"^(\.\.?/)+", "")


def is_system_include(raw: Column) -> Column:
    return F.startswith(F.trim(raw), F.lit("<"))


def collapse(text: Column, most: int = 240) -> Column:
    """White space runs as one space, trimmed, cut to `most` characters with an ellipsis."""
    s = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def first_line(text: Column, most: int = 200) -> Column:
    return collapse(F.regexp_extract(text, "^[^\r\n]*", 0), most)


def base_type_name(text: Column) -> Column:
    """The type's own name: without template arguments, qualifiers, pointers and arrays; the last name that is left."""
    s = F.regexp_replace(text, "<.*>", " ")
    s = F.regexp_replace(s, r"\[[^\]]*\]|[*&]", " ")
    s = F.regexp_replace(s, rf"\b({'|'.join(QUALIFIERS)})\b", " ")
    return F.regexp_extract(F.trim(s), rf"((?:{IDENTIFIER}::)*{IDENTIFIER})\s*$", 1)


def type_from_declaration(declaration: Column, name: str) -> Column:
    """The type in front of the first whole word `name`; '' if the name is not there."""
    return base_type_name(F.regexp_extract(declaration, rf"^(.*?)\b{name}\b", 1))


def distance(path: Column, here: str) -> Column:
    """Steps between the directories of two files: up to the common one and down again."""
    own = F.split(F.regexp_replace(F.lower(normalize_path(path)), "/?[^/]*$", ""), "/")
    other = F.lit([x for x in here.replace("\\", "/").lower().split("/")[:-1]] or [""])
    same = F.zip_with(own, other, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    common = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(1).alias("on")), lambda s, x: F.struct((s["n"] + s["on"] * x).alias("n"), (s["on"] * x).alias("on")), lambda s: s["n"])
    return F.size(own) + F.size(other) - 2 * common


def contains_ignoring_ascii_case(text: Column, query: str) -> Column:
    return F.instr(ascii_lower(text), query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
