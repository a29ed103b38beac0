"""Small manifests of stored tables, switched in one step."""

from __future__ import annotations

import json

from papyra.workspace import Workspace


class Manifest:
    """A JSON file in the folder of ``work``: written aside and renamed, so readers see the old or the new one."""

    def __init__(self, work: Workspace):
        self.work, self.spark = work, work.spark

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.work.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def read(self, empty: dict) -> dict:
        fs, path = self._at("manifest.json")
        return json.loads(self.spark.read.text(self.work.path("manifest.json"), wholetext=True).first()[0]) if fs.exists(path) else empty

    def switch(self, manifest: dict) -> None:
        fs, aside = self._at("manifest-aside.json")
        out = fs.create(aside, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, self._at("manifest.json")[1], options)
