"""Senders for the sink's tests: a service in a folder that knows the keys it has taken, and fails as told."""

from __future__ import annotations

import json
import os
import zlib

from weftline.sources.sink import Refused


class Folder:
    def __init__(self, options):
        self.path = options["folder"]

    def send(self, key, records):
        name = key.replace("/", "-")
        tries = f"{self.path}/{name}.tries"
        with open(tries, "a") as out:
            out.write("x")
        times, draw = os.path.getsize(tries), zlib.crc32(key.encode()) % 6
        if any(r.get("bad") for r in records):
            raise Refused("bad record")
        if draw == 0:
            raise TimeoutError("never answers")
        if draw == 1 and times < 4:
            raise ConnectionError("try later")
        taken = f"{self.path}/{name}.json"
        if not os.path.exists(taken):
            with open(taken, "w") as out:
                json.dump(records, out)
        if draw == 2 and times == 1:
            raise TimeoutError("the answer was lost")


def folder(options):
    return Folder(options)


class Broken(Folder):
    def send(self, key, records):
        super().send(key, records)
        if key.endswith("/1") and not os.path.exists(f"{self.path}/broke"):
            open(f"{self.path}/broke", "w").close()
            raise RuntimeError("the worker dies")


def broken(options):
    return Broken(options)
