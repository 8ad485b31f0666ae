"""Files that an installation needs beside its program, put back where they are missing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from notefold.functions.runtime import CONFIG_NAME, CONFIG_TEMPLATE


@dataclass(frozen=True)
class Restored:
    """code: ASSETS_OK, ASSETS_RESTORED, FOLDER_FAILED, ASSET_NOT_BUNDLED, ASSET_FAILED or CONFIG_FAILED; what concerns: the file or folder of a failure, and why."""

    code: str
    recovered: tuple[str, ...] = ()
    config_created: bool = False
    concerns: str | None = None
    why: str | None = None

    @property
    def ok(self) -> bool:
        return self.code in ("ASSETS_OK", "ASSETS_RESTORED")


def restore_assets(folder: str | Path, required: Sequence[str], bundled: Mapping[str, str]) -> Restored:
    """Write those required files that folder lacks, in their order, then a config from its template; files that exist stay as they are.

    Stops at the first failure, and what was written until then stays and is
    told.  A second call finds nothing to do.
    """
    folder, done = Path(folder), []
    wanted = [(name, name, "ASSET_FAILED") for name in required] + [(CONFIG_NAME, CONFIG_TEMPLATE, "CONFIG_FAILED")]
    try:
        folder.mkdir(parents=True, exist_ok=True)
    except OSError as e:
        return Restored("FOLDER_FAILED", concerns=str(folder), why=str(e))
    for name, source, failure in wanted:
        if (folder / name).exists():
            continue
        if source not in bundled:
            return Restored("ASSET_NOT_BUNDLED", tuple(done), concerns=source)
        try:
            (folder / name).write_text(bundled[source], encoding="utf-8")
        except OSError as e:
            return Restored(failure, tuple(done), concerns=name, why=str(e))
        done.append(name)
    made = CONFIG_NAME in done
    return Restored("ASSETS_RESTORED" if done else "ASSETS_OK", tuple(x for x in done if x != CONFIG_NAME), made)
