"""Small object graphs written as the JSON documents the reader expects."""

from __future__ import annotations

import json

TYPES = {"undefined": 1, "boolean": 2, "number": 3, "string": 4, "symbol": 5, "null": 6, "exception": 7}
BUILTIN = {"constructor", "toString", "valueOf", "toLocaleString", "hasOwnProperty"}


class Graph:
    """Objects are numbered from 100 in order of creation; the root comes first."""

    def __init__(self, with_base: bool = True):
        self.doc = {"data": {}, "functions": {}, "metadata": {}, "protos": {}, "toStrings": {},
                    "types": TYPES, "root": 100, "key": "window"}
        self.root = self.obj()
        if with_base:
            self.object_proto = self.obj()
            self.function_proto = self.obj(proto=self.object_proto)
            self.object = self.fn("Object", self.object_proto)
            self.function = self.fn("Function", self.function_proto)
            for key in ("toString", "valueOf", "constructor"):
                self.put(self.object_proto, key, self.object if key == "constructor" else 6)
            for key in ("call", "apply", "length", "name"):
                self.put(self.function_proto, key, 6)
            self.put(self.root, "Object", self.object)
            self.put(self.root, "Function", self.function)

    def obj(self, proto=None, text=None, **members):
        node = 100 + len(self.doc["data"])
        self.doc["data"][str(node)] = {}
        if proto is not None:
            self.doc["protos"][str(node)] = proto
        if text is not None:
            self.doc["toStrings"][str(node)] = text
        for key, child in members.items():
            self.put(node, key, child)
        return node

    def put(self, node, key, child, value=None):
        stored = f"+{key}+" if key in BUILTIN else key
        self.doc["data"][str(node)][stored] = child
        if value is not None:
            self.doc["metadata"].setdefault(str(node), {})[key] = {"value": value}
        return self

    def fn(self, name, prototype, link_back=True):
        node = self.obj(proto=getattr(self, "function_proto", None))
        self.put(node, "prototype", prototype)
        self.put(node, "length", 3)
        self.put(node, "name", 4)
        if name:
            self.doc["functions"][str(node)] = name
        if link_back:
            self.put(prototype, "constructor", node)
        return node

    def write(self, folder, name="window_Alpha_1.0_Zulu_2.0.json", environment=None):
        doc = dict(self.doc)
        if environment:
            doc["environment"] = environment
        (folder / name).write_text(json.dumps(doc))
        return str(folder)
