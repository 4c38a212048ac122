"""``python -m keelstone FOLDER put KEY VALUE | get KEY | del KEY | scan FROM TO | compact | snapshot``"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .store import KeyValueStore


def main(args: list[str]) -> int:
    need = {"put": 2, "get": 1, "del": 1, "scan": 2, "compact": 0, "snapshot": 0}
    if len(args) < 2 or args[1] not in need or len(args) - 2 != need[args[1]]:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    store, (verb, *rest) = KeyValueStore(spark, args[0]), args[1:]
    if verb == "put":
        store.put(*rest)
        print("OK")
    elif verb == "get":
        value = store.get(*rest)
        print("(nil)" if value is None else value)
    elif verb == "del":
        store.delete(*rest)
        print("OK")
    elif verb == "scan":
        for row in store.scan(*rest).toLocalIterator():
            print(f"{row['key']}\t{row['value']}")
    elif verb == "compact":
        store.compact()
    else:
        print(store.snapshot())
    store.close()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
