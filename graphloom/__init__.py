"""graphloom: property-graph analytics over file trees and tables, on PySpark."""

__version__ = "0.1.0"
