"""Column expressions over paths, names and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import trees

# The suffix of an archive name, and the clip suffixes of an episode name.
ARCHIVE_SUFFIX = r"_L\d+_nf\d+_res\d+_new\d+_s\d+of\d+"
CLIP_SUFFIX = r"[-_](?:clip|chunk|part|segment|window)\d+|[-_]frames?\d+(?:[-_]\d+)?"


def archive_stem(name: Column, allow_cv: bool = False) -> Column:
    """B1: the name without the archive suffix; others pass. ``allow_cv``: a trailing ``_cv<digits>`` too."""
    tail = ARCHIVE_SUFFIX + (r"(?:_cv\d+)?" if allow_cv else "")
    stem = F.regexp_extract(name, rf"^(.+?){tail}$", 1)
    return F.when(stem != "", stem).otherwise(name)


def parts_of(path: Column) -> Column:
    """The non-empty parts of a POSIX path."""
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def base_name(path: Column) -> Column:
    return F.try_element_at(parts_of(path), F.lit(-1))


def without_suffix(path: Column) -> Column:
    """The path without its last suffix; a leading dot of the name isn't one."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def relative_stem(path: Column, root: str, sort_key: bool = False) -> Column:
    """B2: the path below ``root`` without suffix. Others: ``_external/<16 hex digits>/name``, or ``external/<path>`` as a sort key."""
    prefix = root.rstrip("/") + "/"
    inside = F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    outside = F.concat(F.lit("external/"), path) if sort_key else F.concat_ws("/", F.lit("_external"), F.substring(F.sha2(path, 256), 1, 16), without_suffix(base_name(path)))
    return F.when(F.startswith(path, F.lit(prefix)), without_suffix(inside)).otherwise(outside)


def unsafe_reason(path: Column, suffix: str | None = None) -> Column:
    """Why a path isn't a canonical relative POSIX path, null if it is one."""
    parts = F.split(path, "/")
    reason = (
        F.when(path.isNull() | (path == ""), "empty")
        .when(F.contains(path, F.lit("\0")), "nul")
        .when(F.contains(path, F.lit("\\")), "backslash")
        .when(F.startswith(path, F.lit("/")), "absolute")
        .when(F.exists(parts, lambda p: (p == ".") | (p == "..")), "dots")
        .when(F.exists(parts, lambda p: p == ""), "not canonical")
    )
    if suffix is not None:
        reason = reason.when(~F.endswith(F.lower(path), F.lit(suffix.lower())), "suffix")
    return reason


def is_safe_relpath(path: Column, suffix: str | None = None) -> Column:
    return unsafe_reason(path, suffix).isNull()


def episode_stem(stem: Column) -> Column:
    """Clip suffixes taken off, however many; the whole name if nothing else is left."""
    cut = F.regexp_replace(stem, rf"(?i)(?:{CLIP_SUFFIX})+$", "")
    return F.when(cut == "", stem).otherwise(cut)


def _after(parts: Column, markers: list[str]) -> Column:
    """The part after the first marker that isn't the last part."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), lambda i: F.struct(F.lower(F.get(parts, i)).alias("a"), F.get(parts, i + 1).alias("b")))
    hit = F.filter(pairs, lambda x: x["a"].isin(markers) & x["b"].isNotNull() & ~x["b"].isin("", ".", ".."))
    return F.get(hit, F.lit(0))["b"]


def _prefixed(parts: Column, prefix: str) -> Column:
    heads = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.get(F.filter(heads, lambda p: F.rlike(p, F.lit(rf"(?i)^{prefix}(?:[-_].+|\d.*)$"))), F.lit(0))


def capture_of(stem: Column) -> Column:
    parts = parts_of(stem)
    return F.coalesce(_after(parts, ["capture", "captures"]), _prefixed(parts, "capture"))


def take_of(stem: Column) -> Column:
    """The take: by marker, by prefix, the part before the frame folder, the first folder, or the name itself."""
    parts = parts_of(stem)
    low = F.transform(parts, F.lower)
    before = lambda marker: F.when(F.array_position(low, marker) > 1, F.get(parts, (F.array_position(low, marker) - 2).cast("int")))
    first = F.when((F.size(parts) > 1) & (F.get(parts, F.lit(0)) != ".."), F.get(parts, F.lit(0)))
    return F.coalesce(_after(parts, ["take", "takes"]), _prefixed(parts, "take"), before("frame_aligned_videos"), before("frame_aligned_video"), first, F.try_element_at(parts, F.lit(-1)))


def group_key(stem: Column, dataset: str, mode: str = "auto", regex: str | None = None) -> Column:
    """The leakage group of a relative stem, prefixed by its kind; null where the rule finds none.

    ``dataset`` is ``tasks`` (folders are tasks) or ``takes``. A regex comes
    first: its group named ``group``, else its first group, else the match.
    """
    if regex is not None:
        import re

        compiled = re.compile(regex)
        number = compiled.groupindex.get("group") or (1 if compiled.groups else 0)
        java = re.sub(r"\(\?P<", "(?<", regex)
        value = F.regexp_replace(F.trim(F.regexp_extract(stem, java, number)), r"^[/\\]+|[/\\]+$", "")
        return F.when(value != "", F.concat(F.lit("regex:"), value))
    parent = F.regexp_replace(stem, r"/?[^/]*$", "")
    name = episode_stem(base_name(stem))
    nested = ~parent.isin("", ".")
    if dataset == "tasks":
        mode = "parent" if mode == "auto" else mode
        kinds = {"parent": F.when(nested, F.concat(F.lit("task:"), parent)).otherwise(F.concat(F.lit("episode:"), name)), "episode_stem": F.concat(F.lit("episode:"), F.when(nested, F.concat_ws("/", parent, name)).otherwise(name))}
    elif dataset == "takes":
        mode = "take" if mode == "auto" else mode
        kinds = {
            "capture": F.concat(F.lit("capture:"), capture_of(stem)),
            "take": F.concat(F.lit("take:"), take_of(stem)),
            "parent": F.when(nested, F.concat(F.lit("parent:"), parent)).otherwise(F.concat(F.lit("video:"), name)),
            "episode_stem": F.concat(F.lit("video:"), F.when(nested, F.concat_ws("/", parent, name)).otherwise(name)),
        }
    else:
        raise ValueError(f"unknown dataset {dataset!r}")
    if mode not in kinds:
        raise ValueError(f"mode {mode!r} isn't for {dataset!r}")
    return kinds[mode]


def joint_name(name: Column) -> Column:
    """Camel case and underscores to kebab case."""
    s = F.regexp_replace(F.trim(name), "([a-z0-9])([A-Z])", "$1-$2")
    s = F.regexp_replace(F.lower(F.regexp_replace(s, "_", "-")), "-+", "-")
    return F.regexp_replace(s, "^-|-$", "")


def path_variants(rel_dir: Column, leaf: str | None = None) -> Column:
    """Other folders to look in, the best first: without a doubled first part, without the leaf (once, twice), without ``partN``."""
    parts = parts_of(rel_dir)
    tail = lambda k: F.when(F.size(parts) > k, F.array_join(F.slice(parts, F.lit(k + 1), F.size(parts)), "/"))
    part = lambda k: F.get(parts, F.lit(k))
    found = [F.array_join(parts, "/"), F.when(part(0) == part(1), tail(1))]
    if leaf:
        found += [F.when(part(0) == leaf, tail(1)), F.when((F.size(parts) >= 3) & (part(0) == leaf) & (part(1) == leaf), tail(2))]
    found.append(F.when(F.rlike(part(0), F.lit(r"^part\d+$")), tail(1)))
    return F.array_distinct(F.array_compact(F.array(*found)))


def pick_instruction(kind: Column, direction: Column, first: Column, second: Column) -> Column:
    """The second description if the kind is ``reversible`` and the direction isn't 1; the first if anything is missing."""
    use_second = (kind == "reversible") & (direction != "1") & second.isNotNull()
    return F.when(use_second, second).otherwise(first)


def is_host_path(value: Column) -> Column:
    """Whether a string is a path of one machine."""
    return F.coalesce(F.rlike(value, F.lit(r"^(?:/|\\\\|[A-Za-z]:[\\/]|file://)")), F.lit(False))


def host_paths(df: DataFrame, column: str, root: str = "$", depth: int = trees.DEPTH) -> DataFrame:
    """``df`` without ``column``, a nested JSON record, with path and value of each string in it that is a path of one machine.

    Strings are looked for at any level, in lists and objects; names aren't.
    """
    return trees.walk(df, column, root, depth).filter((F.col("kind") == "string") & is_host_path(F.col("value"))).drop("parent", "kind")


def portable_ref(value: Column, root: str) -> Column:
    """The path below ``root``, else its last part; empty stays empty."""
    prefix = root.rstrip("/") + "/"
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(F.coalesce(base_name(text), F.lit("")))


def parse_id_list(spec: Column) -> Column:
    """Distinct integers of a list with commas or white space; other parts are ignored."""
    return F.array_distinct(F.array_compact(F.transform(F.split(F.trim(spec), r"[,\s]+"), lambda p: p.try_cast("int"))))


def is_sha256(value: Column, any_case: bool = False) -> Column:
    """B14."""
    return F.rlike(value, F.lit(f"^[0-9a-f{'A-F' if any_case else ''}]{{64}}$"))


def is_commit_sha(value: Column) -> Column:
    """40 hex digits."""
    return F.rlike(value, F.lit("^[0-9a-f]{40}$"))
