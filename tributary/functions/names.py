"""Column functions on ids: names, labels, layers, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of each layer, in the order in which they are tried.
LAYERS = {
    "CONTROLLER": ("Controller", "Resource", "Endpoint"),
    "SERVICE": ("Service", "ServiceImpl", "Manager"),
    "REPOSITORY": ("Mapper", "Repository", "Dao"),
    "DOMAIN": ("Entity", "Domain", "Model", "VO", "DTO"),
    "CONFIG": ("Config", "Configuration", "Properties"),
    "UTIL": ("Util", "Utils", "Helper", "Constants"),
}
# Display names of file extensions.
LANGUAGES = {"java": "Java", "js": "JavaScript", "ts": "TypeScript", "tsx": "TSX", "jsx": "JSX", "py": "Python", "vue": "Vue", "svelte": "Svelte"}


def layer(id_: Column, custom: dict[str, str] | None = None) -> Column:
    """The layer that a class name's suffix tells: own suffixes first, then the usual ones; UNKNOWN for none, null and empty."""
    simple = F.regexp_extract(F.coalesce(id_, F.lit("")), r"([^.]*)$", 1)
    simple = F.regexp_replace(simple, r"(?s)^([^$]+)\$.*$", "$1")
    out = None
    for suffix, name in [*(custom or {}).items(), *((s, k) for k, v in LAYERS.items() for s in v)]:
        out = F.when(simple.endswith(suffix), F.lit(name)) if out is None else out.when(simple.endswith(suffix), F.lit(name))
    return out.otherwise(F.lit("UNKNOWN"))


_CLASS = r"(?s)^.+\.(\p{Lu}[^.]*)$"


def label(id_: Column) -> Column:
    """What a drawing calls a node: the class name, else the last part of a path, else the id."""
    return F.when(id_.rlike(_CLASS), F.regexp_extract(id_, _CLASS, 1)).when(id_.rlike("(?s)^.+/"), F.substring_index(id_, "/", -1)).otherwise(id_)


def short_name(id_: Column, path_first: bool = True) -> Column:
    """The last part of a path, or the class name of a dotted id; path_first says which is tried first."""
    path, cls = F.substring_index(id_, "/", -1), F.regexp_extract(id_, _CLASS, 1)
    if path_first:
        return F.when(id_.contains("/"), path).when(id_.rlike(_CLASS), cls).otherwise(id_)
    return F.when(id_.rlike(_CLASS), cls).when(id_.contains("/"), path).otherwise(id_)


def mermaid_id(id_: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(id_, "[.:]", "_"), "[^a-zA-Z0-9_]", "")


def language(extension: Column) -> Column:
    """The display name of an extension; the extension itself where there is none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension), extension)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty if there is none or it starts the name."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"(?s)^.+\.([^.]*)$", 1)


def relative(path: Column, root: str) -> Column:
    """The path below root, with slashes only."""
    forward = F.replace(path, F.lit("\\"), F.lit("/"))
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(forward.startswith(prefix), F.substr(forward, F.lit(len(prefix) + 1))).otherwise(forward)


def java_hash(s: Column) -> Column:
    """The 32-bit string hash h = 31 h + code unit, as a signed number; for text of the basic plane."""
    whole = F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(whole > 0x7FFFFFFF, whole - F.lit(1 << 32)).otherwise(whole)


def pastel(domain: Column) -> Column:
    """A light colour that follows from a domain's name."""
    h = java_hash(domain)
    part = lambda bits: F.lpad(F.lower(F.hex(F.lit(180) + F.abs(F.shiftright(h, bits) % 60))), 2, "0")
    return F.concat(F.lit("#"), part(0), part(8), part(16))


def on_critical_path(id_: Column, fragments: Column) -> Column:
    """Whether any fragment occurs in the id, whatever the case."""
    return F.exists(fragments, lambda f: F.contains(F.lower(id_), F.lower(f)))


def crosses(a: Column, b: Column) -> Column:
    """Whether two domains are known and differ."""
    return F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))


def rotated(cycle: Column) -> Column:
    """A cycle turned so that its smallest member is first."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.when(F.size(cycle) < 2, cycle).otherwise(F.concat(F.slice(cycle, at, F.size(cycle)), F.slice(cycle, F.lit(1), at - 1)))


def file_matches(path: Column, id_: Column, ext: Column) -> Column:
    """Whether a file's path names a node: Java ids are class names, others are paths."""
    tail = F.when(ext == "java", F.concat(F.replace(id_, F.lit("."), F.lit("/")), F.lit(".java"))).otherwise(id_)
    return (path == tail) | path.endswith(F.concat(F.lit("/"), tail))
