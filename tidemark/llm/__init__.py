"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  ``queries()`` and
``oracles()`` list its registered queries.
"""


def queries():
    from . import registry

    return registry.queries()


def oracles():
    from . import registry

    return registry.oracles()
