"""Analytics over person-period segments; every function takes and returns DataFrames."""
