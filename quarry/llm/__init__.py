"""Operations for preparing training data: ten operators over texts and web pages.

Nothing else in quarry imports this subpackage.
"""
