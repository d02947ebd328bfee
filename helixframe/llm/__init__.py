"""Operations of a training-data pipeline, one module per operator.

Nothing outside this subpackage imports it.
"""
