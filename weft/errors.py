"""The one exception of the library."""

from __future__ import annotations


class ProjectError(Exception):
    """Something in a project is wrong.  ``code`` is stable, ``where`` names the object, the text says what to do."""

    def __init__(self, code: str, message: str, where: str = "") -> None:
        super().__init__(f"{where}: {message}" if where else message)
        self.code, self.where = code, where
