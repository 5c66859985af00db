"""Every named query but those of the training-data operators."""

from lexforge.functions import text  # noqa: F401
from lexforge.operators import affixes, cuts, engine, learning, more, packing, registry, restoring, roots, sampling, segment, stores, vectors  # noqa: F401
from lexforge.plans.dialect import CATALOGUE


def queries():
    return {name: q.run for name, q in CATALOGUE.items()}


def oracle_sql():
    return {name: q.oracle for name, q in CATALOGUE.items() if q.oracle}
