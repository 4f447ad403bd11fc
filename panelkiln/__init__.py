"""panelkiln: Spark-native analytics for event-driven longitudinal panels.

Every operator is a function ``DataFrame -> DataFrame``; nothing here runs
an action unless its docstring says so.
"""

__version__ = "0.1.0"
