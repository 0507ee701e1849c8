"""Operations of a training-data pipeline: ten operators over documents, pages, labels and conversations.

Nothing outside this folder imports it.
"""
