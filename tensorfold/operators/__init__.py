"""Operations on tensors as DataFrame transformations."""
