"""Operations of a training-data pipeline on document tables; nothing outside this folder imports it."""
