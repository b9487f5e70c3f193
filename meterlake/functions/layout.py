"""Names of repositories and projects out of working directories."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_REPOSITORY, UNKNOWN_PROJECT = "unknown-repository", "unknown-project"


def _named(path: Column, aliases: Mapping[str, str]) -> Column:
    """The name that configuration gives exactly this path."""
    if not aliases:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), path)


def _plain(path: Column) -> Column:
    """A path without doubled slashes, dots that stay where they are, and a slash at its end."""
    return F.regexp_replace(F.regexp_replace(path, r"/(\.?/)+", "/"), r"/\.?$", "")


def _found(path: Column, aliases: Mapping[str, str], worktrees: str | None, repositories: str | None, ignore: Collection[str]) -> Column:
    """A path's repository, or null."""
    roots = [re.escape(r.rstrip("/")) for r in (worktrees, repositories) if r]
    if not roots:
        return _named(path, aliases)
    # The first root that holds the path decides, as a group that isn't tried again; a root itself has no name.
    no = "".join(f"|{re.escape(i)}(?:/|$)" for i in ignore)
    below = f"^(?!(?:{'|'.join(roots)})$)(?>{'|'.join(f'{r}/' for r in roots)})(?!\\.{no})([^/]+)"
    return F.coalesce(_named(path, aliases), F.nullif(F.regexp_extract(_plain(path), below, 1), F.lit("")))


def repository(path: Column, aliases: Mapping[str, str], worktrees: str | None = None, repositories: str | None = None, ignore: Collection[str] = ()) -> Column:
    """A directory's repository: by an alias of just this path, else the first folder below the root of worktrees, else below that of repositories.

    The roots themselves name none, nor do ignored folders and those that begin with a dot.
    """
    found = _found(path, aliases, worktrees, repositories, ignore)
    return F.coalesce(F.when(path != "", found), F.lit(UNKNOWN_REPOSITORY))


def project(path: Column, projects: Mapping[str, str], aliases: Mapping[str, str], worktrees: str | None = None, repositories: str | None = None, ignore: Collection[str] = ()) -> Column:
    """A directory's project: by an alias of just this path, else its repository if there is a root at all."""
    rooted = [_found(path, aliases, worktrees, repositories, ignore)] if worktrees or repositories else []
    return F.coalesce(F.when(path != "", F.coalesce(_named(path, projects), *rooted)), F.lit(UNKNOWN_PROJECT))
