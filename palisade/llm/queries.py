"""All registered queries of this subpackage; importing this module imports every operator."""

from importlib import import_module

from palisade.llm import common

_MODULES = ["quality", "chat", "tokens", "pii", "pieces", "hosts", "lines", "decontaminate", "jaccard", "substrings",
            "licenses", "centroids", "runs"]


def load():
    for name in _MODULES:
        import_module(f"palisade.llm.{name}")
    return common
