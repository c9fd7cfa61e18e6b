"""Single text files from rows, by Arrow's file systems, so that shared folders of any kind can be written."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from notemill.operators.spread import spread


def write_files(files: DataFrame, root: str) -> int:
    """Write each (path, content) as the file ``root/path``; returns how many there were.

    Rows without path or content are left out.  A task that is repeated writes the same again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                folder = f"{base}/{path}".rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(content.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    own = spread(files.select("path", "content").where("path is not null and content is not null"))
    return sum(r["n"] for r in own.mapInPandas(run, "n long").groupBy().sum("n").toDF("n").collect() if r["n"])
