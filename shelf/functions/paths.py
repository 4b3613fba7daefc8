"""Path expressions. A path is a plain string with ``/`` between its parts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# File types and folder names the tools know.
INDEX_TYPES = (".jpeg", ".jpg", ".png", ".pdf")
IMAGE_TYPES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff")
RENAME_TYPES = (".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff", ".bmp", ".gif", ".pdf")
OUTPUT_FOLDERS = ("export_output", "pdf", "similar_review", "auto_cropped")


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_text(value: Column | str) -> Column:
    """A root folder may be one text for all rows or a column."""
    return F.lit(value) if isinstance(value, str) else value


def as_root(value: Column | str) -> Column:
    """A root folder without the slashes at its end; ``/`` itself becomes the empty text."""
    return F.lit(value.rstrip("/")) if isinstance(value, str) else F.regexp_replace(value, "/+$", "")


def dirname(path: Column | str) -> Column:
    return F.regexp_extract(as_column(path), r"^(.*)/[^/]*$", 1)


def basename(path: Column | str) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def extension(name: Column | str) -> Column:
    """Last suffix with its dot; leading dots of a name never start one."""
    return F.regexp_extract(as_column(name), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(name: Column | str) -> Column:
    name = as_column(name)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def parent_name(path: Column | str) -> Column:
    return basename(dirname(path))


def _is_output_or_hidden(segment: Column, output_folders) -> Column:
    return segment.startswith(".") | segment.isin(*output_folders)


def relative_to(path: Column | str, root: Column | str) -> Column:
    """Path below ``root``; a path elsewhere stays as it is."""
    path, root = as_column(path), as_root(root)
    return F.when(
        path.startswith(F.concat(root, F.lit("/"))),
        F.substring(path, F.length(root) + 2, F.length(path)),
    ).otherwise(path)


def folders_below(path: Column | str, root: Column | str) -> Column:
    """Array of the folder names between ``root`` and the file."""
    parts = F.split(relative_to(path, root), "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def pruned(path: Column | str, root: Column | str, output_folders=OUTPUT_FOLDERS) -> Column:
    """True when a folder between ``root`` and the file is hidden or an output folder."""
    return F.exists(folders_below(path, root), lambda s: _is_output_or_hidden(s, output_folders))


def skipped_folder(folder: Column | str, output_folders=OUTPUT_FOLDERS) -> Column:
    return _is_output_or_hidden(as_column(folder), output_folders)


_STORE = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)?"


def in_scope(path: Column | str, root: Column | str) -> Column:
    """True when the path, with ``.`` and ``..`` resolved, lies below ``root``. Scheme and authority of a path in
    another store (``s3a://bucket``) belong to it; slashes at the end of ``root`` do not matter."""
    path = as_column(path)
    segments = F.filter(F.split(F.regexp_replace(path, _STORE, ""), "/"), lambda s: (s != "") & (s != "."))
    # an empty array literal of strings starts the walk; `..` drops the last part kept so far
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.regexp_extract(path, _STORE, 0), F.lit("/"), F.array_join(kept, "/")).startswith(
        F.concat(as_root(root), F.lit("/"))
    )


def climb_out_of_dates(path: Column | str) -> Column:
    """Drop month and day folders from the end of a path, so work starts above them."""
    return F.regexp_replace(
        as_column(path), r"(?<=.)(/(\d{2}-\d{4}|\d{2}-\d{2}-\d{4}))+$", ""
    )


def _decimal_digits() -> tuple[str, str]:
    foreign = [
        chr(c)
        for c in range(0x80, 0x10000)
        if unicodedata.category(chr(c)) == "Nd"
    ]
    return "".join(foreign), "".join(str(unicodedata.digit(c)) for c in foreign)


_FOREIGN, _ASCII = _decimal_digits()


def plain_digits(text: Column | str) -> Column:
    """Decimal digits of every script (Arabic-Indic among them) as 0-9."""
    return F.translate(as_column(text), _FOREIGN, _ASCII)


def path_from_uri(uri: Column | str) -> Column:
    """Path from the encoded URI that the image reader reports; only the scheme of local files is left out."""
    return F.url_decode(F.replace(path_from_scheme(uri), F.lit("+"), F.lit("%2B")))


def path_from_scheme(path: Column | str) -> Column:
    """Path from the decoded ``scheme:/path`` that the file reader reports. Files of other stores keep scheme and
    authority, so that equal paths in two buckets stay apart."""
    return F.regexp_replace(as_column(path), r"^[fF][iI][lL][eE]:(//[^/]*)?(?=/)", "")
