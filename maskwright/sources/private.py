"""Files that only their owner may read, written whole or not at all."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path


def write_private(path: str | Path, data: str, force: bool = False) -> None:
    """Write with mode 0600 and move into place. Without force an existing file stays; links are never followed."""
    path = Path(path)
    handle, temp = tempfile.mkstemp(dir=path.parent or Path("."))  # made with mode 0600
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if force:
            os.replace(temp, path)
        else:
            os.link(temp, path)  # fails if the name is taken, also by a link
            os.unlink(temp)
    except FileExistsError:
        os.unlink(temp)
        raise FileExistsError(f"{path} already exists") from None
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise
