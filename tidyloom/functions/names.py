"""Rules on column and file names.  Pure metadata work, plus the same file-name rules as column expressions."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyloom.config import ID_NAME_TOKENS


def clean_name(raw: object) -> str:
    """Lower snake case of ASCII letters, digits and single underscores; ``col`` if nothing is left."""
    snake = re.sub(r"[^0-9A-Za-z_]", "", "_".join(str(raw).split()))
    return re.sub(r"_{2,}", "_", snake).lower() or "col"


def unique_names(names: Iterable[str]) -> list[str]:
    """Give every repeat, whatever its case, the first numeric suffix that no earlier column uses."""
    taken: set[str] = set()
    result = []
    for name in names:
        candidate, n = name, 0
        while candidate.lower() in taken:
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate.lower())
        result.append(candidate)
    return result


def name_has_token(name: str, tokens: Iterable[str]) -> bool:
    lowered = name.lower()
    return any(token in lowered for token in tokens)


def is_id_name(name: str, tokens: Iterable[str] = ID_NAME_TOKENS) -> bool:
    """Does the name look like an identifier?  A plain substring rule, so ``notes`` and ``width`` count too."""
    return name_has_token(name, tokens)


def dataset_name(file_name: str | None, record_id: object = None) -> str:
    """Output name of a dataset: the file name without its extension, or ``api_<id>``."""
    return os.path.splitext(file_name or f"api_{record_id}")[0].strip()


def file_format(file_name: str, file_path: str | None = None) -> str:
    """Lower-case extension without the dot, from the name or else from the path."""
    ext = os.path.splitext(file_name)[1] or os.path.splitext(file_path or "")[1]
    return ext.lower().lstrip(".")


_STEM = r"^(\.*[^.].*)\.[^.]*$"
_EXTENSION = r"^\.*[^.].*\.([^.]*)$"


def dataset_name_col(file_name: Column, record_id: Column | None = None) -> Column:
    """``dataset_name`` over a table of files."""
    name = F.nullif(file_name, F.lit(""))
    if record_id is not None:
        name = F.coalesce(name, F.concat(F.lit("api_"), record_id.cast("string")))
    stem = F.nullif(F.regexp_extract(name, _STEM, 1), F.lit(""))
    return F.trim(F.coalesce(stem, name))


def file_format_col(file_name: Column, file_path: Column | None = None) -> Column:
    """``file_format`` over a table of files; an empty string if there is no extension."""
    ext = F.nullif(F.regexp_extract(file_name, _EXTENSION, 1), F.lit(""))
    if file_path is not None:
        ext = F.coalesce(ext, F.regexp_extract(F.element_at(F.split(file_path, "/"), -1), _EXTENSION, 1))
    return F.lower(F.coalesce(ext, F.lit("")))
