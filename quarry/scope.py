"""Scope filters: which projects and users a query may see, compiled to one predicate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """Projects to include (none: all), projects to exclude, users to include (none: all).

    A row whose project is null never passes an include or exclude list, as in SQL. Every branch of a
    search applies all parts, excludes too.
    """

    projects: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    users: tuple[str, ...] = field(default=())

    @classmethod
    def parse(cls, text: str | None) -> Scope:
        """From ``a,b,-c,@user``: plain names include, ``-`` excludes, ``@`` names a user; ``all`` or
        nothing is everything."""
        parts = [p.strip() for p in (text or "").split(",") if p.strip() and p.strip() != "all"]
        return cls(
            tuple(p for p in parts if p[0] not in "-@"),
            tuple(p[1:] for p in parts if p[0] == "-"),
            tuple(p[1:] for p in parts if p[0] == "@"),
        )

    def predicate(self, project: str = "project", user: str | None = None) -> Column:
        test = F.lit(True)
        if self.projects:
            test = test & F.col(project).isin(*self.projects)
        if self.excludes:
            test = test & ~F.col(project).isin(*self.excludes)
        if self.users and user:
            test = test & F.col(user).isin(*self.users)
        return test


def resolve_scope(flag: str | None, config: str | None, workspace: tuple[str, ...] | None, cwd_project: str | None) -> Scope:
    """The first that says something: explicit flag, repository config, workspace, current project."""
    if flag is not None:
        return Scope.parse(flag)
    if config is not None:
        return Scope.parse(config)
    if workspace:
        return Scope(tuple(workspace))
    return Scope((cwd_project,)) if cwd_project else Scope()
