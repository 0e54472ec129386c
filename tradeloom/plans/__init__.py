"""The registered queries, each with its SQL where SQL can express it: catalogue.QUERIES and catalogue.SQL hold all of them."""

from . import catalogue, classified, linked, records, searches, shapes, values  # noqa: F401
