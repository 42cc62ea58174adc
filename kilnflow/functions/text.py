"""Names, labels and other text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilnflow.constants import SPACE, SPACE_CHARS

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: ColumnOrName) -> Column:
    """Remove white space of any kind from both ends (``trim`` knows the space only)."""
    return F.btrim(_col(text), F.lit(SPACE_CHARS))


def slugify(text: ColumnOrName, n: int = 50) -> Column:
    """File-name stem: cut to ``n`` code points, then keep letters, digits, `` -_``."""
    kept = F.regexp_replace(F.substring(_col(text), 1, n), r"[^\p{L}\p{N} _-]+", "")
    stem = F.replace(F.trim(kept), F.lit(" "), F.lit("_"))
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("generated_image"))


def session_key(name: ColumnOrName, day: ColumnOrName | None = None) -> Column:
    """Folder name of a session, with ``_yyyyMMdd`` when a day is given."""
    given = F.coalesce(F.nullif(_col(name), F.lit("")), F.lit("generation"))
    kept = F.regexp_replace(given, rf"[^\p{{L}}\p{{N}}_{SPACE}-]+", "")
    key = F.replace(strip(kept), F.lit(" "), F.lit("_"))
    return key if day is None else F.concat(key, F.lit("_"), F.date_format(_col(day), "yyyyMMdd"))


def all_steps_key(prompt: ColumnOrName, day: ColumnOrName) -> Column:
    """Session name of an all-steps run: first word in lower case, then the day."""
    first = F.regexp_extract(_col(prompt), f"^[{SPACE}]*([^{SPACE}]+)", 1)
    return F.concat(F.lower(first), F.lit("_allsteps_"), F.date_format(_col(day), "yyyyMMdd"))


def token_count(text: ColumnOrName) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(_col(text), F.lit(f"[^{SPACE}]+"))


def prompt_preview(text: ColumnOrName, n: int = 50) -> Column:
    """First ``n`` code points and three dots, which short text gets too."""
    return F.concat(F.substring(_col(text), 1, n), F.lit("..."))


def escape_markup(text: ColumnOrName) -> Column:
    """Escape text for display in a page; ``&`` goes first."""
    out = _col(text)
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\u00a0", "&nbsp;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def size_label(size: ColumnOrName) -> Column:
    """``1024x768`` shown with a multiplication sign; the first ``x`` only."""
    return F.regexp_replace(_col(size), "^([^x]*)x", "$1×")


def seed_label(seed: ColumnOrName) -> Column:
    """The seed as text; none and 0 both show as random."""
    return F.coalesce(F.nullif(_col(seed), F.lit(0)).cast("string"), F.lit("random"))


def parse_size(size: ColumnOrName) -> Column:
    """``WxH`` as a struct of two integers, null where a part is not a number."""
    parts = F.split(_col(size), "x")
    return F.struct(
        F.get(parts, F.lit(0)).try_cast("int").alias("width"),
        F.get(parts, F.lit(1)).try_cast("int").alias("height"),
    )


def step_of_total_name(step: ColumnOrName, total: ColumnOrName) -> Column:
    return F.format_string("step_%03d_of_%03d.png", _col(step), _col(total))


def steps_name(prefix: ColumnOrName, steps: ColumnOrName, digits: int = 2) -> Column:
    """``{prefix}_{steps}steps.png``; ``digits`` is a minimum, long numbers stay whole."""
    return F.format_string(f"%s_%0{int(digits)}dsteps.png", _col(prefix), _col(steps))


def first_occurrence(parts: ColumnOrName, name: str = "outputs") -> Column:
    """Drop every repeat of ``name`` in an array, keeping the first."""
    parts = _col(parts)
    first = F.array_position(parts, F.lit(name)) - 1
    return F.filter(parts, lambda part, i: (part != name) | (i == first))


def normalize_base(path: ColumnOrName, name: str = "outputs") -> Column:
    """Base folder without repeated ``outputs``; one that ends in it becomes just that."""
    path = _col(path)
    root = F.when(path.rlike("^//(?!/)"), "//").when(path.startswith("/"), "/").otherwise("")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = first_occurrence(parts, name)
    joined = F.concat(root, F.array_join(kept, "/"))
    return F.when(F.get(kept, F.size(kept) - 1) == name, F.lit(name)).otherwise(
        F.coalesce(F.nullif(joined, F.lit("")), F.lit("."))
    )


def session_path(
    base: ColumnOrName, session: ColumnOrName, filename: ColumnOrName, subdir: ColumnOrName
) -> Column:
    """Path of a file: ``images`` and ``data`` are folders, all else sits in the root."""
    folder = F.when(_col(subdir).isin("images", "data"), _col(subdir))
    return F.concat_ws("/", _col(base), _col(session), folder, _col(filename))
