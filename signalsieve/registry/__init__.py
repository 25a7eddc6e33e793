"""Registered queries. ``load`` imports every family once."""


def load():
    from signalsieve.registry import base
    from signalsieve.registry import catalog, model, reports, store, streams, text  # noqa: F401

    return base.QUERIES, base.ORACLES
