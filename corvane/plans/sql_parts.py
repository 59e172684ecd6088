"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations


def any_of(col: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


BASENAME = "regexp_extract({0}, '([^/]*)$', 1)"


def basename(col: str) -> str:
    return BASENAME.format(col)


LINES = "select {keep}, unnest(string_split(content, chr(10))) as line, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line_number from repository_files where content is not null"
#: Lines at any line end, without an empty last one.
ANY_SPLIT = r"regexp_split_to_array({0}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
