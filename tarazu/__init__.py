"""tarazu: a PySpark-native engine for checking declared invoice lines against a versioned catalog.

Sub-packages: ``functions`` (Column -> Column), ``operators`` (DataFrame -> DataFrame), ``sources``,
``plans`` (registered queries and their SQL), ``streaming``.  ``llm`` holds the operators for training text and
is optional: nothing else imports it.
"""
