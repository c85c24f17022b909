"""Bindings of the operators to the driver tables, registered queries and
their independent SQL formulations."""
