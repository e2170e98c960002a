"""Training-data operators: ten corpus tools that stand apart from the raster engine.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``entries`` registers one thin query per operator.
"""
