"""sparkloom: PySpark-native analytics operators.

Every operator is a function from DataFrame(s) to DataFrame.  Nothing here creates a
session; plans stay declarative so that Catalyst and AQE choose the physical strategy.
"""
